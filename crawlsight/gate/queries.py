"""The registered queries: every operator run on the test tables.

Each takes (spark, sf_dir). Doubles are rounded to 6 places and timestamps shown as text
here, for comparison only; the library returns them untouched.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import network
from ..plans import jobs, sql_functions
from ..operators import (allowlist as allow, evaluation, features as feat, profiles, rollups,
                         scoring, sessions, training, validation)
from ..schemas import MODEL_FEATURES
from ..session import prepare, scratch_dir, written
from ..sources import (event_log, features as feature_table, groundtruth, logs, metrics,
                       profiles as profile_store, sample_log as sample)
from ..sources.daily_sketches import DailySketches
from ..sources.event_pages import EventPages
from ..sources.intake import Intake
from ..sources.versioned_profiles import VersionedProfiles
from ..streaming import alerts, cells, checks, features as live_features, monitors, run

QUERIES: dict = {}

# Limits of the stand-in log; the library defaults are 100 and 500 per minute.
IP_LIMIT, SUBNET_LIMIT = 30, 50


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(prepare(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def plain(df: DataFrame) -> DataFrame:
    shown = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            col = F.round(col, 6)
        elif isinstance(field.dataType, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.BooleanType, T.IntegerType)):
            col = col.cast("bigint")
        shown.append(col.alias(field.name))
    return df.select(*shown)


# -- inputs -------------------------------------------------------------------

def log_of(spark, sf) -> DataFrame:
    return sample.access_log(sample.read_events(spark, sf)).drop("gt_is_robot")


def features_of(spark, sf) -> DataFrame:
    return feat.ip_features(log_of(spark, sf))


def events_of(spark, sf, clock_column: str = "epoch_s") -> DataFrame:
    scored = sample.scored_requests(sample.read_events(spark, sf))
    seconds = (F.unix_micros("raw_ts") / F.lit(1e6) if clock_column == "raw_ts"
               else F.col("epoch_s").cast("double"))
    return event_log.event_rows(scored.withColumn("timestamp", seconds))


def allowlist_of(spark) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in sample.ALLOWLIST_LINES], "value string")
    return allow.parse_allowlist(lines)


def requests_of(spark, sf) -> DataFrame:
    """Requests under the address of their first hop."""
    resolved = validation.client_ip(sample.forwarded_requests(sample.read_events(spark, sf)))
    return resolved.drop("ip").withColumnRenamed("client_ip", "ip")


def scores_of(spark, sf) -> DataFrame:
    return sample.labelled_scores(sample.read_events(spark, sf))


# -- sources and sinks --------------------------------------------------------

@query
def read_access_log(spark, sf):
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    records = log_of(spark, sf).select(
        "ip", F.when(e % 50 == 13, "not a time").otherwise(stamp).alias("timestamp"), "useragent",
        F.col("path").alias("resource"), "method",
        F.when(e % 50 == 9, "abc").otherwise(F.col("status_code").cast("string")).alias("response"),
        F.when(e % 50 == 11, "12.5").otherwise(F.concat(F.lit(" "), F.col("bytes_sent"))).alias("bytes"))
    path = scratch_dir(spark, "ndjson")
    logs.write_ndjson(records, path)
    return logs.read_logs(spark, path, layout="raw").drop("gt_is_robot")


@query
def normalize_raw_dump(spark, sf):
    e = F.col("event_id")
    body = F.to_json(F.struct(
        "ip", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "useragent",
        F.col("path").alias("resource"), "method",
        F.when(e % 50 == 9, "n/a").otherwise(F.col("status_code").cast("string")).alias("response"),
        F.concat(F.lit(" "), F.col("bytes_sent").cast("string"), F.lit(" ")).alias("bytes")),
        {"ignoreNullFields": "false"})
    line = F.concat(F.lit('  "'), e.cast("string"), F.lit('": '), body, F.lit(","))
    lines = log_of(spark, sf).select(
        F.when(e % 50 == 7, F.left(line, F.lit(40))).when(e % 50 == 17, "{")
        .when(e % 50 == 27, "}").when(e % 50 == 37, "   ").otherwise(line).alias("value"))
    path = scratch_dir(spark, "dump")
    lines.write.text(path)
    return logs.read_dump(spark, path)


def faulty_lines(spark, sf, dump=False):
    """The log as text lines: some cut short, some without a time, some without a client."""
    e = F.col("event_id")
    body = F.to_json(F.struct(
        "ip", F.when(e % 50 == 13, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        "useragent", F.col("path").alias("resource"), "method", F.col("status_code").cast("string").alias("response"),
        F.col("bytes_sent").cast("string").alias("bytes")))
    line = F.concat(F.lit('  "'), e.cast("string"), F.lit('": '), body, F.lit(",")) if dump else body
    path = scratch_dir(spark, "lines")
    log_of(spark, sf).select(F.when(e % 200 == 7, F.left(line, F.lit(40))).when(e % 200 == 57, "  ")
                             .otherwise(line).alias("value")).write.text(path)
    return path


@query
def rejected_records(spark, sf):
    counts = []
    for name, dump in (("ndjson", False), ("dump", True)):
        intake = Intake(spark, scratch_dir(spark, "intake"), dump)
        intake.land(spark.read.text(faulty_lines(spark, sf, dump)), 1)
        kept = intake.refused().groupBy("verdict").agg(F.count("line").alias("lines_kept"))
        counts.append(intake.ledger().join(kept, "verdict", "left").select(
            F.lit(name).alias("source"), "verdict", "records", F.coalesce("lines_kept", F.lit(0)).alias("lines_kept")))
    return counts[0].unionByName(counts[1])


def streamed_intake(spark, sf):
    folder = scratch_dir(spark, "stream-intake")
    intake = Intake(spark, folder)
    run.finish(intake.stream(faulty_lines(spark, sf), folder + "/checkpoint", once=True))
    return intake


@query
def stream_access_log(spark, sf):
    return streamed_intake(spark, sf).records().drop("gt_is_robot")


@query
def stream_rejected_records(spark, sf):
    intake = streamed_intake(spark, sf)
    refused = intake.refused().select("verdict", F.length("line").cast("long").alias("line_length"))
    return refused.groupBy("verdict").agg(F.count(F.lit(1)).alias("lines_kept"), F.max("line_length").alias("longest")).join(
        intake.ledger().groupBy("verdict").agg(F.sum("records").alias("records")), "verdict").select(
        "verdict", "records", "lines_kept", (F.col("longest") == 40).alias("all_cut"))


@query
def load_features(spark, sf):
    path = scratch_dir(spark, "features")
    feature_table.write_features(features_of(spark, sf), path)
    return feature_table.load_features(spark, path, path + "-csv")


@query
def gt_join(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    joined = documents.join(labels, "doc_id")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    robot = (1 - F.col("quality")).alias("ROBOT")
    folder = scratch_dir(spark, "groundtruth")
    for name, cols in {"simple_features.csv": ["n_chars"],
                       "semantic_features.csv": [words.alias("n_words"), "toxic"]}.items():
        joined.select(F.col("doc_id").alias("ID"), *cols, robot).write.option(
            "header", True).csv(f"{folder}/{name}")
    rows = groundtruth.read_groundtruth(spark, folder)
    return rows.select([F.col(c).cast("bigint").alias(c)
                        for c in ("ID", "n_chars", "n_words", "toxic", "ROBOT")])


def two_models(spark, sf) -> DataFrame:
    """Scores of two scorers over the same labelled requests."""
    first = scores_of(spark, sf)
    second = F.round(F.least(F.col("score") * 1.3, F.lit(1.0)), 4)
    return (first.withColumn("model", F.lit("random_forest"))
            .unionByName(first.withColumns({"score": second, "model": F.lit("gradient_boosting")})))


def label_correlations(spark, sf) -> DataFrame:
    """Strength of each feature's relation to the label: stand-in importances."""
    table = features_of(spark, sf)
    strengths = table.agg(*[
        F.coalesce(F.nanvl(F.abs(F.corr(F.col(c).cast("double"), F.col("is_robot").cast("double"))),
                           F.lit(0.0)), F.lit(0.0)).alias(c) for c in MODEL_FEATURES])
    return strengths.unpivot([], MODEL_FEATURES, "feature", "importance")


def stored_document(spark, sf) -> DataFrame:
    results = written(evaluation.evaluate(two_models(spark, sf)), "results")
    counts = rollups.class_balance(scores_of(spark, sf), "label")
    document = metrics.metrics_document(
        results, label_correlations(spark, sf), counts, evaluation.choose_model(results),
        MODEL_FEATURES, profiles.MODEL_VERSION, label="heuristic")
    path = scratch_dir(spark, "metrics")
    metrics.write_metrics(document, path)
    return metrics.read_metrics(spark, path)


@query
def model_comparison(spark, sf):
    return metrics.model_comparison(stored_document(spark, sf))


@query
def feature_importances(spark, sf):
    return metrics.feature_importances(stored_document(spark, sf))


@query
def headline_model(spark, sf):
    documents = stored_document(spark, sf)
    missing = metrics.read_metrics(spark, scratch_dir(spark, "no-document"))
    return metrics.headline(missing, documents)


@query
def append_events(spark, sf):
    scored = sample.scored_requests(sample.read_events(spark, sf)).withColumn(
        "timestamp", F.col("epoch_s").cast("double"))
    path = scratch_dir(spark, "event-log")
    event_log.append_events(scored.filter("is_bot = 1"), path, 0)
    rest = scored.filter("is_bot is null or is_bot = 0")
    event_log.append_events(rest, path, 1)
    event_log.append_events(rest, path, 1)  # the same batch once more
    return event_log.read_events(spark, path).drop("event_date", "batch_id")


def seeded(spark, sf) -> DataFrame:
    return profiles.seed_profiles(features_of(spark, sf))


def stored_profiles(spark, sf) -> DataFrame:
    """Profiles as a table, the way scoring jobs find them."""
    return written(seeded(spark, sf), "profiles")


@query
def seed_profiles(spark, sf):
    return seeded(spark, sf)


@query
def profile_upsert(spark, sf):
    old = stored_profiles(spark, sf)
    scored = scoring.score_requests(log_of(spark, sf).filter("ip is not null"), old)
    updates = profiles.check_updates(scored.withColumn("updated_at", F.col("event_id")))
    return profiles.upsert(old, profiles.latest_cells(updates))


@query
def profile_lookup(spark, sf):
    return profiles.profile_lookup(profiles.as_families(seeded(spark, sf)))


def flagged_requests(scored: DataFrame) -> DataFrame:
    return scored.filter("is_bot").select(
        "ip", F.col("epoch_s").alias("flagged_at"), "reason",
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("request_count"))


@query
def active_alerts(spark, sf):
    stored = stored_profiles(spark, sf)
    scored = scoring.score_requests(log_of(spark, sf).filter("ip is not null"), stored)
    now = log_of(spark, sf).agg(F.max("epoch_s")).scalar()
    return profiles.active_alerts(profiles.alerts(flagged_requests(scored), stored), now)


@query
def allowlist_parse(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    host = F.concat_ws(".", F.lit("10"), text(u % 3), text(u % 7), text(u % 250))
    lines = log_of(spark, sf).select(
        F.when(e % 6 == 0, F.col("ip"))
        .when(e % 6 == 1, F.concat(F.lit("  "), F.col("ip"), F.lit(" ")))
        .when(e % 6 == 2, F.concat(F.lit("# "), F.col("ip")))
        .when(e % 6 == 3, F.concat(host, F.lit("/"), text(8 + u % 25)))
        .when(e % 6 == 4, F.concat(host, F.lit("/"), text(30 + u % 6)))
        .otherwise("").alias("value"))
    return allow.parse_allowlist(lines)


@query
def flagged_ips(spark, sf):
    return scoring.flagged_ips(scoring.score(features_of(spark, sf)))


@query
def cidr_blocklist(spark, sf):
    return rollups.cidr_blocklist(rollups.cidr_totals(events_of(spark, sf)))


# -- projections and filters --------------------------------------------------

@query
def validate_requests(spark, sf):
    e = F.col("event_id")
    messy = log_of(spark, sf).select(
        "event_id",
        F.when(e % 10 == 1, F.concat(F.lit(" "), F.col("ip"))).when(e % 10 == 2, "bad host")
        .when(e % 10 == 4, "  ").otherwise(F.col("ip")).alias("ip"),
        F.when(e % 10 == 3, F.substr("path", F.lit(2)))
        .when(e % 10 == 6, F.concat(F.lit("/"), F.repeat(F.lit("p"), F.lit(2048))))
        .otherwise(F.col("path")).alias("path"),
        F.when(e % 10 == 5, F.repeat(F.lit("u"), F.lit(1025))).otherwise(
            F.col("useragent")).alias("useragent"))
    return validation.validate_requests(messy).select("event_id", "ip", "reject_reason")


@query
def allowlist_split(spark, sf):
    rows = allow.flag_allowlisted(requests_of(spark, sf), allowlist_of(spark))
    return rows.select("event_id", "ip", "allowlisted")


@query
def model_matrix(spark, sf):
    table = features_of(spark, sf)
    rate = F.col("requests_per_hour")
    dirty = (table.withColumn("requests_per_hour", F.when(rate > 1000, F.lit("inf"))
                              .when(F.col("ua_is_browser") == 1, "n/a")
                              .otherwise(rate.cast("string")))
             .withColumn("ua_entropy", F.nullif("ua_entropy", F.lit(0.0))))
    features = training.feature_columns(dirty)
    matrix = written(training.model_matrix(dirty, features=features), "matrix")
    return training.scaled_columns(matrix, features)


@query
def recent_events(spark, sf):
    return rollups.recent_events(events_of(spark, sf), limit=40, offset=5, show="humans")


@query
def events_since(spark, sf):
    feed = rollups.events_since(events_of(spark, sf), 500)
    return feed.select("event_id", "ip", "timestamp", "path", "risk_score", "is_bot")


def paged_log(spark, sf) -> EventPages:
    """The event log in two batches that overlap, one of them stored twice; a file holds a hundredth of it."""
    events = sample.read_events(spark, sf)
    pages = EventPages(spark, scratch_dir(spark, "event-pages"), rows_per_file=max(events.count() // 100, 1))
    scored = sample.scored_requests(events).withColumn("timestamp", F.col("epoch_s").cast("double"))
    pages.append(scored.filter("is_bot = 1"), 0)
    for _ in range(2):
        pages.append(scored.filter("is_bot is null or is_bot = 0"), 1)
    return pages


@query
def events_page(spark, sf):
    """The third page of humans before an id in the middle of the log, each page asked for by the last id of the one before."""
    pages = paged_log(spark, sf)
    before = pages.files().agg(F.max("max_id")).scalar()
    before = spark.range(1).select(F.floor(before / 2)).first()[0]
    for _ in range(2):
        before = pages.page(before, 30, "humans").agg(F.min("event_id")).first()[0]
    return pages.page(before, 30, "humans")


@query
def events_page_compacted(spark, sf):
    """The newest page of robots after the batches were clustered together, a third one being the newest."""
    pages = paged_log(spark, sf)
    pages.append(sample.scored_requests(sample.read_events(spark, sf)).filter("event_id < 0"), 2)
    pages.compact()
    return pages.page(limit=25, show="bots")


def sketched(spark, sf) -> DailySketches:
    """Sketches of the event log in two batches, put together, with a third one after."""
    store = DailySketches(spark, scratch_dir(spark, "daily-sketches"))
    events = events_of(spark, sf, "raw_ts")
    for batch in range(3):
        store.add(events.filter(F.pmod("event_id", F.lit(3)) == batch), batch)
    store.compact()
    store.add(events.filter("event_id % 3 = 0"), 0)  # taken in already
    return store


def _middle_days(spark, sf):
    """All days of the log but the first and the last."""
    first, last = events_of(spark, sf, "raw_ts").select(
        F.to_date(F.timestamp_seconds(F.min("timestamp"))), F.to_date(F.timestamp_seconds(F.max("timestamp")))).first()
    return first + timedelta(days=1), last - timedelta(days=1)


@query
def summary_by_range(spark, sf):
    """Totals from sketch rows alone; distinct counts are compared with exact ones here."""
    first, last = _middle_days(spark, sf)
    day = F.to_date(F.timestamp_seconds("timestamp"))
    exact = rollups.events_summary(events_of(spark, sf, "raw_ts").filter(day.between(F.lit(first), F.lit(last))))
    near = lambda c: F.abs(F.col(f"s.{c}") - F.col(f"e.{c}")) <= F.col(f"e.{c}") * 0.05
    # one row on either side; three standard errors of the sketch
    return (sketched(spark, sf).summary(first, last).alias("s")
            .join(exact.alias("e"), F.col("s.total_events") == F.col("e.total_events"))
            .select("s.total_events", "s.bot_events", "s.human_events", "s.bot_ratio", "s.last_event_at",
                    "e.unique_ips", "e.unique_paths", (near("unique_ips") & near("unique_paths")).alias("sketches_near")))


@query
def top_paths_by_range(spark, sf):
    return sketched(spark, sf).top_paths(*_middle_days(spark, sf))


def reports_of(spark, sf) -> None:
    events_of(spark, sf).createOrReplaceTempView("bot_events")
    sql_functions.register(spark)


@query
def sql_expressions(spark, sf):
    """Every SQL expression, per request."""
    log_of(spark, sf).createOrReplaceTempView("sql_requests")
    sql_functions.register(spark)
    return spark.sql("""SELECT event_id, is_known_bot(useragent) AS known, is_browser(useragent) AS web,
        char_entropy(useragent) AS entropy, client_subnet(ip) AS subnet, rate_limit_key(ip) AS rate_key,
        client_session(ip, epoch_s) AS session_id, time_bucket(epoch_s, 600) AS bucket,
        share_of(event_id % 7, event_id % 11) AS share,
        heuristic_risk(CAST(is_known_bot(useragent) AS INT), NULL) AS risk,
        threat_tier((event_id % 10) / 10D, event_id % 29 = 0) AS tier, subnet_band((event_id % 10) / 10D) AS band
        FROM sql_requests WHERE ip IS NOT NULL""")


def _report(name: str, call: str) -> None:
    def run(spark, sf):
        reports_of(spark, sf)
        return spark.sql(f"SELECT * FROM {call}")

    run.__name__ = name
    query(run)


for _name, _call in [
    ("sql_top_paths", "report_top_paths(20)"), ("sql_subnets", "report_subnets()"),
    ("sql_flagged", "report_flagged(20)"), ("sql_recent", "report_recent(40, before_id => 700)"),
    ("sql_timeseries", "report_timeseries(300)"), ("sql_throughput", "report_throughput(seconds => 300)"),
    ("sql_risk_bins", "report_risk_bins(20)"), ("sql_over_limit", f"report_over_limit({IP_LIMIT})"),
]:
    _report(_name, _call)


# -- scoring ------------------------------------------------------------------

@query
def score_requests(spark, sf):
    scored = scoring.score_requests(requests_of(spark, sf), stored_profiles(spark, sf))
    return scored.select("event_id", "ip", "risk_score", "is_bot", "reason", "session_count",
                         "req_count", "last_seen", "ua_is_known_bot", "ua_is_browser")


@query
def bulk_score(spark, sf):
    wanted = requests_of(spark, sf).select(F.col("event_id").alias("pos"), "ip")
    return scoring.bulk_score(wanted, stored_profiles(spark, sf), allowlist_of(spark))


@query
def batch_score_heuristic(spark, sf):
    return scoring.score_heuristic(features_of(spark, sf)).select(
        "ip", "risk_score", "is_bot", "reason")


@query
def explain_verdicts(spark, sf):
    scored = scoring.score_heuristic(features_of(spark, sf))
    return scoring.explain_verdicts(scored).select("ip", "risk_score", "reason")


@query
def signal_breakdown(spark, sf):
    seen = requests_of(spark, sf).select("ip", F.coalesce("useragent", F.lit("")).alias("useragent"))
    joined = scoring.with_profiles(seen.distinct(), stored_profiles(spark, sf))
    return scoring.signal_breakdown(joined, ["ip", "useragent"])


@query
def signals_allowlisted(spark, sf):
    seen = requests_of(spark, sf).select("ip", F.coalesce("useragent", F.lit("")).alias("useragent"))
    joined = scoring.with_profiles(seen.distinct(), stored_profiles(spark, sf))
    flagged = allow.flag_allowlisted(joined, allowlist_of(spark))
    return scoring.signal_breakdown(flagged, ["ip", "useragent"])


@query
def decisions(spark, sf):
    scored = sample.scored_requests(sample.read_events(spark, sf)).select(
        "event_id", "ip", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce(F.col("is_bot") == 1, F.lit(False)).alias("is_bot"), F.lit("given").alias("reason"))
    return scoring.decide(scored, allowlist_of(spark))


@query
def client_ip(spark, sf):
    rows = sample.forwarded_requests(sample.read_events(spark, sf))
    return validation.client_ip(rows).select("event_id", "client_ip")


# -- features and sessions ----------------------------------------------------

@query
def ip_features(spark, sf):
    return features_of(spark, sf)


@query
def ip_features_two_level(spark, sf):
    log = log_of(spark, sf)
    return feat.ip_features_merged([log.filter("method = 'GET'"), log.filter("method <> 'GET'")])


@query
def ip_labels(spark, sf):
    rows = feat.ip_features(sample.access_log(sample.read_events(spark, sf)))
    return rows.select("ip", "ua_is_known_bot", "rate_404", "is_robot")


@query
def ua_features(spark, sf):
    return feat.ua_features(log_of(spark, sf))


@query
def event_session_ids(spark, sf):
    return events_of(spark, sf).select("event_id", "session_id", "cidr_block")


@query
def request_intervals(spark, sf):
    return sessions.request_intervals(log_of(spark, sf)).select("event_id", "ip", "interval")


@query
def sessionize(spark, sf):
    return sessions.enrich_requests(log_of(spark, sf)).select(
        "event_id", "ip", "interval", "session_index")


@query
def session_summary(spark, sf):
    return sessions.session_summary(log_of(spark, sf))


# -- rollups ------------------------------------------------------------------

def _rollup(name, fn, table, *args):
    def run(spark, sf):
        return fn(table(spark, sf), *args)

    run.__name__ = name
    query(run)


def raw_events_of(spark, sf) -> DataFrame:
    return events_of(spark, sf, "raw_ts")


for _name, _fn, _table, *_args in [
    ("overview", rollups.overview, features_of),
    ("top_bots", rollups.top_bots, features_of),
    ("rate_histogram", rollups.rate_histogram, features_of),
    ("class_balance", rollups.class_balance, features_of),
    ("scatter_sample", rollups.scatter_sample, features_of),
    ("rescore_sample", rollups.rescore_sample, features_of),
    ("event_stats", rollups.event_stats, events_of),
    ("events_summary", rollups.events_summary, events_of),
    ("kpis", rollups.kpis, events_of),
    ("class_share", rollups.class_share, events_of),
    ("top_paths", rollups.top_paths, events_of),
    ("cidr_activity", rollups.cidr_activity, events_of),
    ("top_flagged_ips", rollups.top_flagged_ips, events_of),
    ("top_flagged_avg_risk", rollups.top_flagged_avg_risk, events_of),
    ("top_flagged_stats", rollups.top_flagged_stats, events_of),
    ("alert_timeline", rollups.alert_timeline, events_of),
    ("events_timeseries", rollups.events_timeseries, events_of),
    ("timeseries_share", rollups.timeseries_share, events_of),
    ("throughput_5m", rollups.throughput, events_of, 300),
    ("throughput_10m_by_class", rollups.throughput_by_class, events_of, 600),
    ("dow_hour_heatmap", rollups.dow_hour_heatmap, raw_events_of),
    ("dow_hour_dense", rollups.dow_hour_dense, raw_events_of),
    ("risk_histogram", rollups.risk_histogram, events_of),
    ("sliding_rate", rollups.sliding_rate, raw_events_of),
]:
    _rollup(_name, _fn, _table, *_args)


@query
def feed_merge(spark, sf):
    feed = events_of(spark, sf).select("event_id", "ip", "path", "is_bot")
    return rollups.feed_merge(feed, feed.filter("is_bot = 1"))


@query
def rate_limit_ip(spark, sf):
    open_to_limits = allow.without_allowlisted(events_of(spark, sf), allowlist_of(spark))
    return rollups.rate_limit_violations(open_to_limits, F.col("ip"), IP_LIMIT)


@query
def rate_limit_cidr(spark, sf):
    open_to_limits = allow.without_allowlisted(events_of(spark, sf), allowlist_of(spark))
    return rollups.rate_limit_violations(
        open_to_limits, network.rate_key(F.col("ip")), SUBNET_LIMIT)


# -- evaluation ---------------------------------------------------------------

@query
def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(scores_of(spark, sf))


@query
def choose_threshold(spark, sf):
    return evaluation.choose_threshold(evaluation.threshold_sweep(scores_of(spark, sf)))


@query
def choose_threshold_fallback(spark, sf):
    unrelated = sample.scored_requests(sample.read_events(spark, sf)).filter(
        "risk_score is not null").select(
        F.col("risk_score").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return evaluation.choose_threshold(evaluation.threshold_sweep(unrelated))


@query
def auc_roc(spark, sf):
    return evaluation.auc_roc(scores_of(spark, sf))


@query
def choose_model(spark, sf):
    return evaluation.choose_model(evaluation.evaluate(two_models(spark, sf)))


@query
def cv_folds(spark, sf):
    labels = written(features_of(spark, sf).select("ip", "is_robot"), "labels")
    return evaluation.assign_folds(labels).select("ip", "is_robot", "fold")


# -- streams, run over the available data --------------------------------------

def live_events(spark, sf) -> DataFrame:
    scored = sample.scored_requests(sample.stream_events(spark, sf))
    return scored.filter("ip is not null").withColumn("timestamp", F.col("epoch_s").cast("double"))


def finite(spark, events: DataFrame) -> DataFrame:
    """A stream of finite data with one far-future request, which takes the watermark past all others.

    Its own window, session or alert never closes, so it is in no result.
    """
    path = scratch_dir(spark, "flush")
    last = {"ts": "timestamp'2100-01-01 00:00:00'", "ip": "'flush'", "is_bot": "1", "user_id": "0"}
    spark.range(1).select(*[F.expr(last.get(f.name, "null")).cast(f.dataType).alias(f.name)
                            for f in events.schema.fields]).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


@query
def stream_throughput(spark, sf):
    stream = monitors.throughput(finite(spark, live_events(spark, sf)))
    return run.replay(spark, stream, scratch_dir(spark, "throughput"))


@query
def stream_rate_limit(spark, sf):
    open_to_limits = allow.without_allowlisted(finite(spark, live_events(spark, sf)), allowlist_of(spark))
    stream = monitors.rate_limit_violations(open_to_limits, F.col("ip"), IP_LIMIT)
    return run.replay(spark, stream, scratch_dir(spark, "rate-limit"))


@query
def stream_rate_limit_cidr(spark, sf):
    open_to_limits = allow.without_allowlisted(finite(spark, live_events(spark, sf)), allowlist_of(spark))
    stream = monitors.rate_limit_violations(open_to_limits, network.rate_key(F.col("ip")), SUBNET_LIMIT)
    return run.replay(spark, stream, scratch_dir(spark, "rate-limit-cidr"))


@query
def stream_sessions(spark, sf):
    stream = monitors.client_sessions(finite(spark, live_events(spark, sf)))
    return run.replay(spark, stream, scratch_dir(spark, "sessions"))


@query
def stream_dedup(spark, sf):
    columns = ["event_id", "ts", "ip", "path", "is_bot"]
    twice = live_events(spark, sf).select(columns).unionByName(live_events(spark, sf).select(columns))
    return run.replay(spark, monitors.deduplicated(twice), scratch_dir(spark, "dedup"))


@query
def stream_alerts(spark, sf):
    stream = alerts.alert_periods(finite(spark, live_events(spark, sf)))
    return run.replay(spark, stream, scratch_dir(spark, "alerts"))


@query
def stream_alert_transitions(spark, sf):
    stream = alerts.alert_transitions(finite(spark, live_events(spark, sf)))
    return run.replay(spark, stream, scratch_dir(spark, "alert-transitions"))


@query
def stream_sliding_rate(spark, sf):
    stream = monitors.sliding_rate(finite(spark, live_events(spark, sf)))
    return run.replay(spark, stream, scratch_dir(spark, "sliding-rate"))


@query
def stream_alerts_live(spark, sf):
    folder = scratch_dir(spark, "live-alerts")
    stored = stored_profiles(spark, sf)
    keep = alerts.alert_handler(folder + "/alerts", stored)

    def handle(batch, batch_id):
        keep(flagged_requests(scoring.score_requests(batch, stored)), batch_id)

    requests = live_events(spark, sf).drop("risk_score", "is_bot")
    run.finish(run.to_batches(requests, handle, folder + "/checkpoint", once=True))
    now = log_of(spark, sf).agg(F.max("epoch_s")).scalar()
    return profile_store.read_active_alerts(spark, folder + "/alerts", now)


@query
def stream_summary(spark, sf):
    """Running totals, and exact distinct counts from the event log that the stream writes."""
    folder = scratch_dir(spark, "summary")
    run.finish(run.to_batches(monitors.summary(live_events(spark, sf)), run.snapshots(folder + "/t"),
                              folder + "/checkpoint", once=True, mode="complete"))
    run.finish(run.to_batches(
        live_events(spark, sf), lambda batch, i: event_log.append_events(batch, folder + "/log", i),
        folder + "/log-checkpoint", once=True))
    exact = rollups.events_summary(event_log.read_events(spark, folder + "/log"))
    near = lambda c: F.abs(F.col(f"s.{c}") - F.col(f"e.{c}")) <= F.col(f"e.{c}") * 0.15
    # one row on either side; three standard errors of the sketch
    return (run.latest_snapshot(spark, folder + "/t").alias("s")
            .join(exact.alias("e"), F.col("s.total_events") == F.col("e.total_events"))
            .select("s.total_events", "s.bot_events", "e.unique_ips", "e.unique_paths",
                    "s.last_event_at", (near("unique_ips") & near("unique_paths")).alias("sketches_near")))


def checked(spark, sf, persist: bool, versioned: bool = False) -> checks.CheckTables:
    tables = checks.CheckTables(scratch_dir(spark, "checks"))
    versions = VersionedProfiles(spark, tables.profiles) if versioned else None
    requests = live_events(spark, sf).drop("risk_score", "is_bot")
    handler = checks.batch_handler(spark, tables, allowlist_of(spark), stored_profiles(spark, sf),
                                   persist=persist, versions=versions)
    run.finish(run.to_batches(requests, handler, tables.folder + "/checkpoint", once=True))
    return tables


@query
def stream_score(spark, sf):
    return spark.read.parquet(checked(spark, sf, False).decisions).drop("batch_id")


def persisted(spark, tables: checks.CheckTables, stored) -> DataFrame:
    events = event_log.read_events(spark, tables.events).groupBy("ip").agg(
        F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_event"))
    live = profile_store.read_active_alerts(
        spark, tables.alerts, events.agg(F.max("last_event")).scalar())
    return (events.join(stored.select("ip", "risk_score", "is_bot", "ua_is_known_bot"), "ip")
            .join(live.select("ip", "flagged_at", "request_count_at_flag"), "ip", "left"))


@query
def stream_persist(spark, sf):
    tables = checked(spark, sf, True)
    return persisted(spark, tables, profile_store.read_profiles(spark, tables.profiles))


@query
def stream_persist_versioned(spark, sf):
    """Live checks on the versioned store, read after its deltas were folded and buckets split."""
    tables = checked(spark, sf, True, versioned=True)
    store = VersionedProfiles(spark, tables.profiles, rows=20)
    store.fold()
    return persisted(spark, tables, store.read())


@query
def profiles_at_version(spark, sf):
    """Request counts and risks of an early version of the store and of the newest one."""
    store = VersionedProfiles(spark, scratch_dir(spark, "versions"), rows=20)
    rows = features_of(spark, sf).select("ip", F.lit(0.0).alias("updated_at"), "req_count", "is_robot", "rate_404")
    first = store.append(rows.withColumn("risk_score", F.col("is_robot").cast("double")), "first", written_at=1)
    store.fold()
    store.append(rows.filter("req_count > 50").select("ip", "updated_at", F.lit(0.5).alias("risk_score")), "second", written_at=2)
    store.fold()
    store.append(rows.filter("is_robot = 1").select("ip", "updated_at", F.lit(-1).alias("req_count")), "third", written_at=3)
    side = lambda df, name: df.select("ip", *[F.col(c).alias(f"{name}_{c}") for c in ("req_count", "risk_score")])
    return side(store.read(), "newest").join(side(store.read(first), "first"), "ip")


@query
def stream_features_tiered(spark, sf):
    folder = scratch_dir(spark, "tiered-features")
    log_of(spark, sf).repartition(20).write.parquet(folder + "/log")  # ten micro-batches, however long the log
    stream = (spark.readStream.schema(log_of(spark, sf).schema)
              .option("maxFilesPerTrigger", 2).parquet(folder + "/log"))
    store = cells.FeatureCells(spark, folder + "/cells", fanout=3)
    run.finish(run.to_batches(stream, store.add, folder + "/checkpoint", once=True))
    return store.features()


@query
def stream_features(spark, sf):
    folder = scratch_dir(spark, "live-features")
    log_of(spark, sf).repartition(4).write.parquet(folder + "/log")
    stream = (spark.readStream.schema(log_of(spark, sf).schema)
              .option("maxFilesPerTrigger", 1).parquet(folder + "/log"))
    run.finish(run.to_batches(stream, live_features.partials_handler(folder),
                              folder + "/checkpoint", once=True))
    return live_features.current_features(spark, folder)


# -- models ---------------------------------------------------------------------

def matrix_of(spark, sf) -> DataFrame:
    """Model inputs, written once for the many passes of training."""
    return written(training.model_matrix(features_of(spark, sf), features=MODEL_FEATURES), "matrix")


def candidates(features):
    return {"random_forest": training.random_forest(features),
            "gradient_boosting": training.gradient_boosting(features)}


def _fitted(spark, sf, name: str):
    matrix = matrix_of(spark, sf)
    return training.fit(candidates(MODEL_FEATURES)[name], matrix, MODEL_FEATURES), matrix


def _train(name: str):
    """Verdicts of a model about the rows it has learnt from; the scores themselves have no SQL."""
    def run_query(spark, sf):
        model, matrix = _fitted(spark, sf, name)
        scores = training.probabilities(model, matrix, MODEL_FEATURES, "ip")
        return scores.select("ip", "label", (F.col("score") >= 0.5).alias("verdict"))

    return run_query


@query
def train_rf(spark, sf):
    return _train("random_forest")(spark, sf)


@query
def train_gbt(spark, sf):
    return _train("gradient_boosting")(spark, sf)


@query
def rf_importances(spark, sf):
    rows = training.importances(_fitted(spark, sf, "random_forest")[0], MODEL_FEATURES)
    return rows.select("feature", (F.col("importance") >= 0).alias("valid"),
                       F.round(rows.agg(F.sum("importance")).scalar(), 6).alias("total"))


@query
def oof_scores(spark, sf):
    scores = written(training.out_of_fold(candidates(MODEL_FEATURES)["random_forest"],
                                          matrix_of(spark, sf), MODEL_FEATURES), "oof")
    right = F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int"))
    return scores.select("ip", "label", "fold", F.col("score").between(0, 1).alias("valid"),
                         (scores.agg(right).scalar() >= 0.9).alias("mostly_right"))


_SWEEP_OF_STORED = """
    WITH grid AS (SELECT explode(sequence(30, 70)) AS t), at AS (
        SELECT t, count_if(score >= t / 100D AND label = 1) AS tp, count_if(score >= t / 100D AND label = 0) AS fp,
               count_if(score < t / 100D AND label = 1) AS fn FROM {scores}, grid GROUP BY t)
    SELECT CAST(t AS BIGINT) AS percent, tp AS sql_tp, fp AS sql_fp, fn AS sql_fn FROM at"""


@query
def oof_sweep(spark, sf):
    """The sweep over stored out-of-fold scores against plain SQL over those same scores."""
    scores = written(training.out_of_fold(candidates(MODEL_FEATURES)["random_forest"],
                                          matrix_of(spark, sf), MODEL_FEATURES), "oof-sweep")
    mine = evaluation.threshold_sweep(scores).withColumn(
        "percent", F.round(F.col("threshold") * 100).cast("bigint"))
    plain_sql = spark.sql(_SWEEP_OF_STORED, scores=scores)
    same = (F.col("tp") == F.col("sql_tp")) & (F.col("fp") == F.col("sql_fp")) & (F.col("fn") == F.col("sql_fn"))
    return mine.join(plain_sql, "percent", "full_outer").select(
        "percent", F.coalesce(same, F.lit(False)).alias("same"), (F.col("tp") + F.col("fn")).alias("positives"))


@query
def batch_score_model(spark, sf):
    path = scratch_dir(spark, "model")
    _fitted(spark, sf, "random_forest")[0].write().overwrite().save(path)
    model = PipelineModel.load(path)
    scored = scoring.score_with_model(features_of(spark, sf), model, 0.5)
    return scored.select("ip", F.col("risk_score").between(0, 1).alias("valid"), "is_bot", "reason")


@query
def score_requests_model(spark, sf):
    model, _ = _fitted(spark, sf, "random_forest")
    scored = scoring.score_requests(requests_of(spark, sf), stored_profiles(spark, sf), model, 0.35)
    return scored.select("event_id", "ip", "req_count", "session_count", "last_seen", "ua_is_known_bot",
                         "ua_is_browser", F.col("risk_score").between(0, 1).alias("valid"),
                         (F.col("is_bot") == (F.col("risk_score") >= 0.35)).alias("by_threshold"))


@query
def train_groundtruth(spark, sf):
    rows = gt_join(spark, sf)
    features = ["n_chars", "n_words", "toxic"]
    matrix = training.model_matrix(rows, "ID", "ROBOT", features)
    results = training.compare(matrix, features, candidates(features), "ID")
    return results.select("model", F.col("threshold").between(0.3, 0.7).alias("threshold_in_grid"),
                          (F.col("auc_roc") > 0.5).alias("better_than_chance"))


# -- jobs -------------------------------------------------------------------------

@query
def prepare_twice(spark, sf):
    """A log of two sources after one of them was prepared again without its last day."""
    folder = scratch_dir(spark, "prepare")
    log = log_of(spark, sf).filter("ip IS NOT NULL").select(
        "ip", F.date_format("raw_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "useragent", "path",
        "method", "status_code", "bytes_sent", "event_id")
    last_day = log.agg(F.max(F.substring("timestamp", 1, 10))).scalar()
    logs.write_ndjson(log.filter("event_id % 2 = 0").drop("event_id"), folder + "/even")
    logs.write_ndjson(log.filter("event_id = 1").drop("event_id"), folder + "/one")
    for name in ("one", "even"):
        jobs.prepare(spark, f"{folder}/{name}", folder + "/log", jobs.NDJSON)
    logs.write_ndjson(log.filter((F.col("event_id") % 2 == 0) & (F.substring("timestamp", 1, 10) != last_day))
                      .drop("event_id"), folder + "/even")
    jobs.prepare(spark, folder + "/even", folder + "/log", jobs.NDJSON)
    return jobs.read_log(spark, folder + "/log").groupBy("day").agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("event_id").alias("ids"),
        F.countDistinct("batch_id").alias("batches"))
