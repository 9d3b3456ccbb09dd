"""Mergeable daily summaries of the event log, for totals over any range of days.

One row per batch, day and verdict: exact counts, HyperLogLog sketches of clients and paths, and a
frequent-items sketch of paths. A range reads such rows only, never events. Distinct counts have a
relative standard error of 1.04 / sqrt(2^LG_K), 1.6 %. Path counts are exact up to 3/4 of the sketch's
slots in different paths; beyond, a path's count is too high by at most its day's events over that number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import bot_share
from ..operators.rollups import NO_PATH
from .segments import Segments

LG_K = 12
TRACKED = 10_000   # paths a sketch tells at most
FIELDS = ("event_date", "is_bot", "n", "last_event_at", "ips", "paths", "frequent")


def sketch_rows(events: DataFrame) -> DataFrame:
    """FIELDS of events with ip, path, timestamp and is_bot, per UTC day and verdict."""
    path = F.coalesce("path", F.lit(NO_PATH)).alias("path")
    return (events.select(F.to_date(clock.as_instant(F.col("timestamp"))).alias("event_date"), "is_bot", "timestamp",
                          "ip", F.col("path").alias("known_path"), path)
            .groupBy("event_date", "is_bot")
            .agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_event_at"),
                 F.hll_sketch_agg("ip", LG_K).alias("ips"), F.hll_sketch_agg("known_path", LG_K).alias("paths"),
                 F.expr(f"approx_top_k_accumulate(path, {TRACKED})").alias("frequent")))


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Sketch rows put together by the given columns."""
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("last_event_at").alias("last_event_at"),
        F.hll_union_agg("ips").alias("ips"), F.hll_union_agg("paths").alias("paths"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))


class DailySketches:
    """Sketch rows below a folder, a segment per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.segments = spark, Segments(spark, path)

    def add(self, events: DataFrame, batch_id: str | int = 0) -> None:
        """Store the sketches of a batch of the event log; storing a batch again replaces it."""
        self.segments.put(batch_id, lambda folder: sketch_rows(events).write.parquet(folder))

    def compact(self) -> None:
        """One row per day and verdict for all batches but the newest."""
        self.segments.merge(lambda folders, folder: merged(
            self.spark.read.parquet(*folders), "event_date", "is_bot").write.parquet(folder))

    def rows(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Sketch rows of the days from `first` to `last`, both included. At least one batch is needed."""
        found = self.spark.read.parquet(*self.segments.folders())
        if first is not None:
            found = found.filter(F.col("event_date") >= F.lit(first))
        return found if last is None else found.filter(F.col("event_date") <= F.lit(last))

    def summary(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The header totals of a range: those of `rollups.events_summary`, distinct counts by sketch."""
        total, bots = F.col("total_events"), F.col("bot_events")
        distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0))
        return self.rows(first, last).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
            F.coalesce(F.sum(F.when(F.col("is_bot") == 1, F.col("n"))), F.lit(0)).alias("bot_events"),
            distinct("ips").alias("unique_ips"), distinct("paths").alias("unique_paths"),
            F.max("last_event_at").alias("last_event_at"),
        ).select("total_events", "bot_events", (total - bots).alias("human_events"),
                 bot_share(bots, total).alias("bot_ratio"), "unique_ips", "unique_paths", "last_event_at")

    def top_paths(self, first: date | None = None, last: date | None = None, limit: int = 20) -> DataFrame:
        """The most frequent paths of a range with their events by verdict; reads at most TRACKED paths a verdict."""
        told = (merged(self.rows(first, last), "is_bot")
                .select("is_bot", F.explode(F.expr(f"approx_top_k_estimate(frequent, {TRACKED})")).alias("t"))
                .select("is_bot", F.col("t.item").alias("path"), F.col("t.count").alias("n")))
        of = lambda verdict: F.coalesce(F.sum(F.when(F.col("is_bot") == verdict, F.col("n"))), F.lit(0))
        return (told.groupBy("path").agg(F.sum("n").alias("total"), of(1).alias("bots"), of(0).alias("humans"))
                .orderBy(F.desc("total"), "path").limit(limit))
