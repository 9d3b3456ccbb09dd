"""Monitoring rollups over the feature table and the event log.

`events` has: event_id, ip, timestamp (epoch seconds), path, risk_score, is_bot (0/1/NULL),
session_id, cidr_block. All aggregates combine map-side; top lists keep k rows per task.
Every top list breaks ties by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, verdicts
from ..functions.numbers import bot_share, ratio, round_exact

NO_PATH = "—"


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _bots() -> Column:
    return count_if(F.col("is_bot") == 1)


def _humans() -> Column:
    return count_if(F.col("is_bot") == 0)


# -- feature table ------------------------------------------------------------

def overview(features: DataFrame) -> DataFrame:
    """Clients, robots, humans, robot share, requests, mean requests per hour."""
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    total, bots = F.col("total_ips"), F.col("bots")
    return features.agg(
        F.count(F.lit(1)).alias("total_ips"),
        zero(F.sum("is_robot")).alias("bots"),
        zero(F.sum("req_count")).alias("total_requests"),
        zero(F.avg("requests_per_hour"), 0.0).alias("rate"),
    ).select(
        "total_ips", "bots", (total - bots).alias("humans"),
        bot_share(bots, total).alias("bot_ratio"), "total_requests",
        round_exact(F.col("rate"), 2).alias("avg_requests_per_hour"))


def top_bots(features: DataFrame, limit: int = 20) -> DataFrame:
    return (features.filter("is_robot = 1")
            .select("ip", "req_count", "requests_per_hour", "rate_404", "ua_entropy",
                    "error_rate", "session_count")
            .orderBy(F.desc("req_count"), "ip").limit(limit))


def rate_histogram(features: DataFrame, width: int = 50, top_bucket: int = 20) -> DataFrame:
    """Clients by request rate; buckets are centred on multiples of the width."""
    bucket = F.least(F.rint(F.col("requests_per_hour") / width), F.lit(float(top_bucket)))
    return (features.groupBy((bucket.cast("bigint") * width).alias("requests_per_hour_bucket"))
            .agg(count_if(F.col("is_robot") == 1).alias("bots"),
                 count_if(F.col("is_robot") == 0).alias("humans")))


def class_balance(features: DataFrame, label: str = "is_robot") -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(F.sum(F.col(label)), F.lit(0)).cast("bigint").alias("n_robots"))


def _shuffled(df: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    order = F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary"))
    return df.orderBy(order, key).limit(limit)


def scatter_sample(features: DataFrame, limit: int = 600, seed: int = 42) -> DataFrame:
    """A repeatable sample of clients for the behaviour scatter."""
    cols = ["ip", "requests_per_hour", "error_rate", "unique_paths_ratio", "ua_entropy",
            "req_count", "is_robot"]
    return _shuffled(features.select(cols), "ip", seed, limit)


def rescore_sample(features: DataFrame, n: int = 200, seed: int = 7) -> DataFrame:
    """min(n, clients) whole feature rows."""
    return _shuffled(features, "ip", seed, n)


# -- event log: totals --------------------------------------------------------

def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("ip").alias("total_ips"),
        _bots().alias("bot_events"),
    ).withColumn("bot_ratio", bot_share(F.col("bot_events"), F.col("total_events")))


def events_summary(events: DataFrame) -> DataFrame:
    """Totals for the header; humans are everything that is not a robot."""
    total, bots = F.col("total_events"), F.col("bot_events")
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), _bots().alias("bot_events"),
        F.countDistinct("ip").alias("unique_ips"),
        F.countDistinct("path").alias("unique_paths"),
        F.max("timestamp").alias("last_event_at"),
    ).select("total_events", "bot_events", (total - bots).alias("human_events"),
             bot_share(bots, total).alias("bot_ratio"), "unique_ips", "unique_paths",
             "last_event_at")


def kpis(events: DataFrame) -> DataFrame:
    return events.agg(
        (F.avg(F.col("is_bot").cast("double")) * 100).alias("bot_pct"),
        F.count(F.lit(1)).alias("total_events"),
        F.avg("risk_score").alias("avg_risk"))


def class_share(events: DataFrame) -> DataFrame:
    return events.groupBy("is_bot").agg(F.count(F.lit(1)).alias("n"))


# -- event log: top lists -----------------------------------------------------

def top_paths(events: DataFrame, limit: int = 20) -> DataFrame:
    return (events.groupBy(F.coalesce("path", F.lit(NO_PATH)).alias("path"))
            .agg(F.count(F.lit(1)).alias("total"), _bots().alias("bots"),
                 _humans().alias("humans"))
            .orderBy(F.desc("total"), "path").limit(limit))


def cidr_totals(events: DataFrame) -> DataFrame:
    """Robot share and band of every subnet."""
    return (events.filter(F.col("cidr_block") != "")
            .groupBy("cidr_block")
            .agg(F.count(F.lit(1)).alias("total"), _bots().alias("bots"),
                 _humans().alias("humans"))
            .withColumn("bot_ratio", bot_share(F.col("bots"), F.col("total")))
            .withColumn("band", verdicts.subnet_band(F.col("bot_ratio"))))


def cidr_activity(events: DataFrame, limit: int = 15) -> DataFrame:
    return cidr_totals(events).orderBy(F.desc("total"), "cidr_block").limit(limit)


def cidr_blocklist(subnets: DataFrame, above: float = 0.5) -> DataFrame:
    """Subnets with a robot share above the limit."""
    return subnets.filter(F.col("bot_ratio") > above).select("cidr_block")


def top_flagged_ips(events: DataFrame, limit: int = 20) -> DataFrame:
    return (events.filter("is_bot = 1").groupBy("ip")
            .agg(F.count(F.lit(1)).alias("req_count"), F.max("risk_score").alias("max_risk"))
            .orderBy(F.desc("req_count"), "ip").limit(limit))


def top_flagged_avg_risk(events: DataFrame, limit: int = 20) -> DataFrame:
    return (events.filter("is_bot = 1").groupBy("ip")
            .agg(F.count(F.lit(1)).alias("req_count"), F.sum("is_bot").alias("bot_hits"),
                 F.avg("risk_score").alias("avg_risk"))
            .orderBy(F.desc("req_count"), "ip").limit(limit))


def top_flagged_stats(events: DataFrame, limit: int = 10) -> DataFrame:
    return (events.groupBy("ip")
            .agg(F.count(F.lit(1)).alias("req_count"), F.max("risk_score").alias("max_risk"),
                 F.max("is_bot").alias("flagged"))
            .orderBy(F.desc_nulls_last("flagged"), F.desc("req_count"), "ip").limit(limit))


_FEED = ["event_id", "ip", "timestamp", "path", "risk_score",
         "is_bot", "cidr_block"]


def _feed(events: DataFrame) -> DataFrame:
    return events.select(*[F.coalesce("is_bot", F.lit(0)).alias(c) if c == "is_bot" else c
                           for c in _FEED])


def recent_events(events: DataFrame, limit: int = 12, offset: int = 0,
                  since_id: int | None = None, show: str = "all") -> DataFrame:
    """Newest events first; unknown verdicts read as human. `show`: all, bots or humans."""
    if since_id is not None:
        events = events_since(events, since_id)
    feed = _feed(events)
    if show == "bots":
        feed = feed.filter("is_bot = 1")
    elif show == "humans":
        feed = feed.filter("is_bot = 0")
    return feed.orderBy(F.desc("event_id")).offset(offset).limit(limit)


def events_since(events: DataFrame, since_id: int) -> DataFrame:
    """Increment of the log after an event id."""
    return events.filter(F.col("event_id") > since_id)


def alert_timeline(events: DataFrame) -> DataFrame:
    """Robot events with their instant; sort or range-partition on write."""
    return events.filter("is_bot = 1").select(
        clock.as_instant(F.col("timestamp")).alias("ts"), "ip", "risk_score", "is_bot", "path")


def feed_merge(incoming: DataFrame, shown: DataFrame, keep: int = 50) -> DataFrame:
    """Put unseen incoming events before the shown ones and keep the newest `keep`.

    The shown feed never exceeds `keep` rows, so it is safe to broadcast.
    """
    shown = shown.orderBy(F.desc("event_id")).limit(keep)
    fresh = incoming.join(F.broadcast(shown.select("event_id")), "event_id", "left_anti")
    rank = lambda df, n: df.withColumn("_rank", F.lit(n))
    return (rank(fresh, 0).unionByName(rank(shown, 1))
            .orderBy("_rank", F.desc("event_id")).limit(keep).drop("_rank"))


# -- event log: over time -----------------------------------------------------

def events_timeseries(events: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    return (events.groupBy(clock.floor_to(F.col("timestamp"), bucket_seconds).alias("t"))
            .agg(_bots().alias("bots"), _humans().alias("humans")))


def timeseries_share(events: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    """Time series with totals, robot percentage and the mean of the totals.

    The mean is a scalar aggregate over the same buckets, so no task sees all of them.
    """
    series = events_timeseries(events, bucket_seconds).withColumn(
        "total", F.col("bots") + F.col("humans"))
    pct = F.coalesce(ratio(F.col("bots"), F.col("total")) * 100, F.lit(0.0))
    return series.withColumn("bot_pct", pct).withColumn(
        "mean_total", series.agg(F.avg("total")).scalar())


def throughput(events: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    start = clock.as_instant(clock.floor_to(F.col("timestamp"), bucket_seconds))
    return events.groupBy(start.alias("bucket")).agg(F.count(F.lit(1)).alias("requests"))


def throughput_by_class(events: DataFrame, bucket_seconds: int = 600) -> DataFrame:
    start = clock.as_instant(clock.floor_to(F.col("timestamp"), bucket_seconds))
    return events.groupBy(start.alias("bucket"), "is_bot").agg(F.count(F.lit(1)).alias("requests"))


def dow_hour_heatmap(events: DataFrame) -> DataFrame:
    """Requests per UTC weekday (0 = Sunday) and hour."""
    ts = clock.as_instant(F.col("timestamp"))
    return (events.groupBy(clock.weekday_from_sunday(ts).alias("dow"), F.hour(ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("requests")))


def dow_hour_dense(events: DataFrame) -> DataFrame:
    """All 168 cells with zeros, and intensity against the busiest cell.

    The grid is 168 rows, and so is the frame its single window partition sees.
    """
    spark = events.sparkSession
    grid = (spark.range(7).select(F.col("id").cast("int").alias("dow"),
                                  F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")))
    filled = grid.join(dow_hour_heatmap(events), ["dow", "hour"], "left").fillna(0, ["requests"])
    peak = F.greatest(F.max("requests").over(Window.partitionBy()), F.lit(1))
    return filled.withColumn("intensity", F.col("requests") / peak)


def risk_histogram(events: DataFrame, bins: int = 20) -> DataFrame:
    """Counts per risk bin; risk 1.0 is a bin of its own."""
    risk_bin = F.floor(F.col("risk_score") * bins) / F.lit(float(bins))
    return (events.filter("risk_score is not null").groupBy(risk_bin.alias("risk_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def _over_limit(events: DataFrame, key: Column, limit: int, slot: Column) -> DataFrame:
    return (events.groupBy(key.alias("client"), slot.alias("minute"))
            .agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit))


def rate_limit_violations(events: DataFrame, key: Column, limit: int) -> DataFrame:
    """Clients with more than `limit` requests in a calendar minute."""
    return _over_limit(events, key, limit, clock.floor_to(F.col("timestamp"), 60))


def sliding_rate(events: DataFrame, window: str = "1 hour", step: str = "5 minutes",
                 ) -> DataFrame:
    """Requests per client in overlapping windows.

    Counted per client and step first. A window belongs to the first step with requests in it, which
    adds up the client's next steps, so that windows are neither shuffled nor held in a hash table.
    """
    ts = clock.as_instant(F.col("timestamp"))
    steps = (events.filter(F.col("ip").isNotNull())
             .select("ip", F.window(ts, step)["start"].alias("at"))
             .groupBy("ip", "at").agg(F.count(F.lit(1)).alias("n")))
    ahead = steps.selectExpr(
        "ip", "at", "lag(at) OVER (PARTITION BY ip ORDER BY at) AS before",
        "collect_list(struct(at, n)) OVER (PARTITION BY ip ORDER BY at "
        f"RANGE BETWEEN CURRENT ROW AND INTERVAL {window} FOLLOWING) AS next")
    starts = f"greatest(before, at - INTERVAL {window}) + INTERVAL {step}"
    return (ahead.selectExpr("ip", "next", f"explode(sequence({starts}, at, INTERVAL {step})) AS window_start")
            .selectExpr("ip", "window_start", f"""aggregate(
                filter(next, s -> s.at < window_start + INTERVAL {window}), 0L, (sum, s) -> sum + s.n) AS requests"""))
