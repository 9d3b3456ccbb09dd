"""Live monitors over a stream of events (`ts`, `ip`, `path`, `is_bot`, ...).

Windows are emitted once the watermark has passed them, so results are final; what is
later than the watermark is left to the batch twin of each monitor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rollups import count_if
from ..operators.sessions import SESSION_GAP_SECONDS
from .run import WATERMARK


def throughput(events: DataFrame, window: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """Requests, robots and humans per window."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"),
                 count_if(F.col("is_bot") == 1).alias("bots"),
                 count_if(F.col("is_bot") == 0).alias("humans"))
            .select(F.col("w.start").alias("bucket"), "requests", "bots", "humans"))


def rate_limit_violations(events: DataFrame, key: Column, limit: int,
                          delay: str = WATERMARK) -> DataFrame:
    """Clients above `limit` requests in a minute."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 minute").alias("w"), key.alias("client"))
            .agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit)
            .select("client", F.col("w.start").alias("minute"), "requests"))


def sliding_rate(events: DataFrame, window: str = "1 hour", step: str = "5 minutes",
                 delay: str = WATERMARK) -> DataFrame:
    """Requests per client in overlapping windows.

    Two chained aggregations: events are counted once per client and step, and closed steps, not
    events, are added up into the windows that overlap.
    """
    steps = (events.filter(F.col("ip").isNotNull()).withWatermark("ts", delay)
             .groupBy("ip", F.window("ts", step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
             .select("ip", "n", F.window_time("step").alias("at")))
    return (steps.groupBy("ip", F.window("at", window, step).alias("w"))
            .agg(F.sum("n").alias("requests"))
            .select("ip", F.col("w.start").alias("window_start"), "requests"))


def client_sessions(requests: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS,
                    delay: str = WATERMARK) -> DataFrame:
    """Finished sessions with first and last request.

    The session setting of `crawlsight.session` merges a client's requests inside each
    task first, so a hot client reaches the state store as few rows.
    """
    session = F.session_window("ts", f"{gap_seconds} seconds").alias("s")
    return (requests.filter(F.col("ip") != "").withWatermark("ts", delay).groupBy("ip", session)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select("ip", F.col("s.start").alias("start_ts"),
                    (F.col("s.end") - F.make_dt_interval(secs=F.lit(gap_seconds))).alias("end_ts"),
                    "requests"))


def summary(events: DataFrame) -> DataFrame:
    """Running totals; distinct counts are sketches of fixed size. Complete mode."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if(F.col("is_bot") == 1).alias("bot_events"),
        F.approx_count_distinct("ip").alias("unique_ips"),
        F.approx_count_distinct("path").alias("unique_paths"),
        F.max("ts").alias("last_event_at"))


def deduplicated(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Every event once, as long as its repeats arrive within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
