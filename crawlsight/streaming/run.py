"""Running streams: sinks, checkpoints, and reading back what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "10 minutes"


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append finished rows to a Parquet table."""
    return _start(stream.writeStream.outputMode("append").format("parquet").option("path", path),
                  checkpoint, once)


def to_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
               once: bool = False, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to `handle(batch, batch_id)`, which must be repeatable."""
    return _start(stream.writeStream.outputMode(mode).foreachBatch(handle), checkpoint, once)


def snapshots(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps every emitted state of a small result under its batch id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return handle


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("batch_id")).scalar()
    return stored.filter(F.col("batch_id") == newest).drop("batch_id")


def finish(query: StreamingQuery) -> None:
    """Wait for a run over the available data."""
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error


def replay(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over the available data and read its table back."""
    finish(to_table(stream, f"{folder}/table", f"{folder}/checkpoint", once=True))
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
