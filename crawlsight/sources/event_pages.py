"""The event log clustered by id, read a page at a time in either direction.

Every batch is sorted by `event_id` into files, and a small table holds the least and greatest id of
each file with its numbers of events by verdict. A page looks there for the files it needs, however
far back it lies, so its cost does not grow with the log. Ids must be unique; events without one are
stored, but are on no page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups
from .event_log import EVENT_LOG, event_rows
from .segments import Segments

ROWS_PER_FILE = 1_000_000
PAGE = 12

_COUNTS = {"all": "rows", "bots": "bots", "humans": "humans"}


class EventPages:
    """A paged event log below a folder."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.rows_per_file = spark, rows_per_file
        self.segments = Segments(spark, path)

    def _store(self, events: DataFrame, folder: str) -> None:
        (events.repartitionByRange("event_id").sortWithinPartitions("event_id")
         .write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{folder}/data"))
        human = F.coalesce("is_bot", F.lit(0)) == 0
        known = self._read([f"{folder}/data"]).filter("event_id IS NOT NULL")
        (known.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
         .agg(F.min("event_id").alias("min_id"), F.max("event_id").alias("max_id"),
              F.count(F.lit(1)).alias("rows"), rollups.count_if(F.col("is_bot") == 1).alias("bots"),
              rollups.count_if(human).alias("humans"))
         .select(F.concat(F.lit(f"{folder}/data/"), "file").alias("file"), "min_id", "max_id", "rows", "bots", "humans")
         .write.parquet(f"{folder}/files"))

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(EVENT_LOG)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], EVENT_LOG)

    def append(self, scored: DataFrame, batch_id: str | int = 0) -> None:
        """Store scored requests as one batch; storing a batch again replaces it."""
        self.segments.put(batch_id, lambda folder: self._store(event_rows(scored), folder))

    def compact(self) -> None:
        """Cluster all batches but the newest together."""
        self.segments.merge(lambda folders, folder: self._store(self._read([f"{f}/data" for f in folders]), folder))

    def files(self) -> DataFrame:
        """file, min_id, max_id, rows, bots, humans of every file."""
        return self.spark.read.schema("file string, min_id long, max_id long, rows long, bots long, humans long").parquet(
            *[f"{folder}/files" for folder in self.segments.folders()])

    def files_of_page(self, before_id: int | None, limit: int, show: str) -> list[str]:
        """The files that hold the `limit` newest events before an id.

        Files wholly before the id are taken, newest first, until they hold a page; nothing below the
        least id of these can be on it. At most `limit` rows of the file table decide that.
        """
        count = _COUNTS[show]
        some = self.files().filter(F.col(count) > 0)
        whole = some
        if before_id is not None:
            some, whole = some.filter(F.col("min_id") < before_id), some.filter(F.col("max_id") < before_id)
        newest = whole.orderBy(F.desc("max_id")).limit(limit).select("min_id", F.col(count).alias("n")).collect()
        found, floor = 0, None
        for row in newest:
            found, floor = found + row.n, row.min_id if floor is None else min(floor, row.min_id)
            if found >= limit:
                some = some.filter(F.col("max_id") >= floor)
                break
        return [r.file for r in some.select("file").collect()]

    def page(self, before_id: int | None = None, limit: int = PAGE, show: str = "all") -> DataFrame:
        """The `limit` newest events before an id, newest first; the last one's id asks for the next page.

        `show`: all, bots or humans (unknown verdicts among them). No id: the newest page.
        """
        if not self.segments.folders():
            return rollups.recent_events(self._read([]), limit, show=show)
        events = self._read(self.files_of_page(before_id, limit, show)).filter("event_id IS NOT NULL")
        if before_id is not None:
            events = events.filter(F.col("event_id") < before_id)
        return rollups.recent_events(events, limit, show=show)

    def since(self, after_id: int) -> DataFrame:
        """Events after an id, from the files that hold any."""
        if not self.segments.folders():
            return self._read([])
        newer = self.files().filter(F.col("max_id") > after_id).select("file").collect()
        return rollups.events_since(self._read([r.file for r in newer]), after_id)
