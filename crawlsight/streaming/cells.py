"""Incremental features in tiers.

Every micro-batch adds one small segment that holds its own (client, second), (client, path) and
(client, agent) cells and touches no other. When a level has FANOUT segments they are merged into
one of the next level, so after n batches a read opens FANOUT - 1 segments per level at most, of
about log n levels, and a cell is rewritten once per level. A manifest names the live segments:
readers keep theirs while others merge, and a batch that runs again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as feat
from ..sources.manifest import Manifest

FANOUT = 8
KEPT_VERSIONS = 32   # readers that have opened one of these may finish
PARTS = ("seconds", "paths", "agents")


class FeatureCells:
    """Stored partial features below a folder."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.manifest = Manifest(spark, self.folder, {"segments": [], "last_batch": -1})

    def segments(self, version: int | None = None) -> list[dict]:
        return self.manifest.read(version)[1]["segments"]

    def _write(self, parts: feat.Partials) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        for part in PARTS:
            getattr(parts, part).hint("rebalance").write.parquet(f"{self.folder}/{name}/{part}")
        return name

    def _partials(self, segments: list[dict]) -> feat.Partials:
        read = lambda part: self.spark.read.parquet(*[f"{self.folder}/{s['name']}/{part}" for s in segments])
        return feat.merge(feat.Partials(**{part: read(part) for part in PARTS}))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Handler for `run.to_batches`: store the cells of a micro-batch of the log once."""
        if batch_id > self.manifest.read()[1]["last_batch"]:
            batch = batch.persist()  # read once for three tables
            try:
                name = self._write(feat.partials(batch))
            finally:
                batch.unpersist()

            def added(state: dict) -> dict:
                if batch_id <= state["last_batch"]:
                    return state
                return {"segments": [*state["segments"], {"name": name, "level": 0}], "last_batch": batch_id}

            self.manifest.commit(added)
        self.merge_full_levels()
        self.manifest.vacuum(lambda state: {s["name"] for s in state["segments"]}, KEPT_VERSIONS)

    def merge_full_levels(self) -> None:
        """Merge the segments of every level that is full."""
        level = 0
        while any(s["level"] >= level for s in self.segments()):
            full = [s for s in self.segments() if s["level"] == level]
            if len(full) >= self.fanout:
                merged = {"name": self._write(self._partials(full)), "level": level + 1}
                gone = {s["name"] for s in full}

                def swapped(state: dict) -> dict:
                    if not gone <= {s["name"] for s in state["segments"]}:
                        return state  # another writer has merged them
                    left = [s for s in state["segments"] if s["name"] not in gone]
                    return {**state, "segments": [*left, merged]}

                self.manifest.commit(swapped)
            level += 1

    def features(self, version: int | None = None) -> DataFrame:
        """Features of everything stored, or of what a version held. At least one batch is needed."""
        return feat.finish(self._partials(self.segments(version)))


def handler(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    return FeatureCells(spark, folder).add
