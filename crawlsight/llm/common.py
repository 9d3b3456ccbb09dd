"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch_dir, scratch_root

# A table of known size is sent to every task up to these bounds; beyond them its join is by shuffle.
SENT_ROWS, SENT_BYTES = 1 << 18, 1 << 24

# A key with at least 1/1024 of all rows is hot; there are 1024 such keys at most.
HOT_SHARE = 1024


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Tables of one run below the shared folder; `drop` removes them when their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_dir(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """For steps whose result is written or collected: their shuffle files go when the block ends.

    Spark removes a shuffle's files when the driver's last reference to it is collected, so the
    references are given up and a collection is asked for, instead of waiting for the next one."""
    yield
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """For steps that hand long rows to Python and run inside the block: a batch has about `n_bytes`, or one row.

    A batch lies in the JVM, outside its heap and in buffers that double as they fill, and in the worker at once;
    Spark's own bound is 64 MB for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def sent(table: DataFrame, n_rows: int, n_bytes: int = 0) -> DataFrame:
    """`table` marked for broadcast if its counted size is within the bounds."""
    return F.broadcast(table) if n_rows <= SENT_ROWS and n_bytes <= SENT_BYTES else table


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def learns(key: Column, modulus: int, held_out: int) -> Column:
    """Whether a row is outside the held-out fold: crc32 of its key as text, modulo `modulus`."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of `rows` with `table` (one row per key) that no hot key can unbalance.

    `table[count]` is how many of the `total` rows hold the key. Keys with 1/1024 of all rows or
    more, so 1024 at most, are joined by broadcast and the rest by shuffle.
    """
    is_hot = F.col(count) * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(table.filter(is_hot))
    cold_rows = rows.join(F.broadcast(table.filter(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(table.filter(~is_hot), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first column, cut where its value changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = pc.index(batch.column(0), batch.column(0)[batch.num_rows - 1]).as_py()
        if cut or held and held[-1].column(0)[0] != batch.column(0)[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
