"""Request intervals and gap sessions.

Time has whole-second resolution, so all requests of a client within one second
share their session and are 0 seconds apart. Every job here first counts the
requests per (client, second) with map-side partial sums; a client that owns most
of the log shrinks to at most one row per second before anything is ordered. The
ordered steps then run per (client, hour), 3,600 rows at most, and per client over
its active hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSION_GAP_SECONDS = 1800
HOUR = 3600


def usable_requests(log: DataFrame) -> DataFrame:
    """Requests with a client and a time."""
    return log.filter((F.col("ip") != "") & F.col("epoch_s").isNotNull())


def number_sessions(cells: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """`gap`, the seconds since the client's previous active second (NULL on its first), and
    `session_index` from 1 per client; a gap above the limit starts a session.

    `cells` has one row per (ip, epoch_s). Inside an hour the gap is a lag. One table of hours
    has what the cells need of the client's earlier hours: the gap before the hour's first
    second, and the number of sessions begun until then.
    """
    cells = cells.withColumn("hour", F.floor(F.col("epoch_s") / HOUR))
    in_hour = Window.partitionBy("ip", "hour").orderBy("epoch_s")
    by_hour = Window.partitionBy("ip").orderBy("hour")
    so_far = Window.unboundedPreceding
    inner = cells.withColumn("_gap", F.col("epoch_s") - F.lag("epoch_s").over(in_hour))
    inner = inner.withColumn("_breaks", F.count(F.when(F.col("_gap") > gap_seconds, 1)).over(
        in_hour.rowsBetween(so_far, Window.currentRow)))
    hours = inner.groupBy("ip", "hour").agg(
        F.min("epoch_s").alias("_first"), F.max("epoch_s").alias("_last"), F.max("_breaks").alias("_inside"))
    hours = hours.withColumn("_edge", F.col("_first") - F.lag("_last").over(by_hour))
    opens = F.when(F.col("_edge").isNull() | (F.col("_edge") > gap_seconds), 1).otherwise(0)
    begun = F.sum(opens).over(by_hour.rowsBetween(so_far, Window.currentRow))
    inside = F.sum("_inside").over(by_hour.rowsBetween(so_far, -1))
    hours = hours.select("ip", "hour", "_edge", (begun + F.coalesce(inside, F.lit(0))).alias("_before"))
    return (inner.join(hours, ["ip", "hour"])
            .withColumns({"gap": F.coalesce("_gap", "_edge"),
                          "session_index": F.col("_before") + F.col("_breaks")})
            .drop("_gap", "_breaks", "_edge", "_before"))


def _active_seconds(log: DataFrame) -> DataFrame:
    return log.groupBy("ip", "epoch_s").agg(
        F.count(F.lit(1)).alias("requests"), F.min("event_id").alias("first_event"))


def enrich_requests(log: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Every usable request with `interval` (NULL on the client's first) and `session_index`."""
    log = usable_requests(log)
    cells = number_sessions(_active_seconds(log), gap_seconds)
    first = F.col("event_id") == F.col("first_event")
    return (log.join(cells.select("ip", "epoch_s", "first_event", "gap", "session_index"),
                     ["ip", "epoch_s"])
            .withColumn("interval", F.when(first, F.col("gap").cast("double")).otherwise(F.lit(0.0)))
            .drop("first_event", "gap"))


def request_intervals(log: DataFrame) -> DataFrame:
    """Every usable request with its `interval` in seconds."""
    return enrich_requests(log).drop("session_index")


def session_summary(log: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """One row per session: first and last second, number of requests."""
    cells = number_sessions(_active_seconds(usable_requests(log)), gap_seconds)
    return cells.groupBy("ip", "session_index").agg(
        F.min("epoch_s").alias("start_s"), F.max("epoch_s").alias("end_s"),
        F.sum("requests").alias("requests"))
