"""Incrementally kept features: every micro-batch adds its partial tables.

Partials of the same (client, second), (client, path) or (client, agent) merge by adding
or taking the minimum, so late requests and any split into batches give the features of
the whole log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as feat
from .run import snapshots

_PARTS = ("seconds", "paths", "agents")


def partials_handler(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores the partials of a micro-batch of the log."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for three tables
        try:
            parts = feat.partials(batch)
            for name in _PARTS:
                snapshots(f"{folder}/{name}")(getattr(parts, name), batch_id)
        finally:
            batch.unpersist()

    return handle


def stored_partials(spark: SparkSession, folder: str) -> feat.Partials:
    tables = {name: spark.read.parquet(f"{folder}/{name}").drop("batch_id") for name in _PARTS}
    return feat.merge(feat.Partials(**tables))


def current_features(spark: SparkSession, folder: str) -> DataFrame:
    return feat.finish(stored_partials(spark, folder))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the merged partials as a single batch elsewhere; run it between batches."""
    parts = stored_partials(spark, folder)
    for name in _PARTS:
        snapshots(f"{target}/{name}")(getattr(parts, name), -1)
