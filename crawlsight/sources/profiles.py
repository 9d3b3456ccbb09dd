"""Stored profiles and alerts: updates appended by batch, read through `latest_cells`.

Profile updates lie in folders of batch and bucket, a bucket being a hash of the client. A reader
that names its clients reads their buckets only. `fold` replaces earlier batches by a single one,
so the cost of a read does not grow with the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profiles import ALERT_TTL_SECONDS, active_alerts, latest_cells, profile_rows
from ..schemas import PROFILE
from ..session import raise_unless_missing, remove

BUCKETS = 64

_STORED = T.StructType(PROFILE.fields + [
    T.StructField("updated_at", T.DoubleType()), T.StructField("batch_id", T.StringType()),
    T.StructField("bucket", T.IntegerType())])
_ALERTS = T.StructType([
    T.StructField("ip", T.StringType()), T.StructField("flagged_at", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("request_count_at_flag", T.LongType()),
    T.StructField("flag_hour", T.LongType()), T.StructField("batch_id", T.StringType()),
])


def bucket_of(ip: str) -> Column:
    return F.pmod(F.xxhash64(ip), F.lit(BUCKETS)).cast("int")


def _replace(df: DataFrame, path: str, batch_id, *partitions: str) -> None:
    """Write one batch; writing it again after a failure replaces it."""
    keys = [F.col(p) for p in partitions if p != "batch_id"]
    (df.withColumn("batch_id", F.lit(str(batch_id))).hint("rebalance", *keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def _replace_updates(rows: DataFrame, path: str, batch_id) -> None:
    _replace(rows.withColumn("bucket", bucket_of("ip")), path, batch_id, "batch_id", "bucket")


def write_updates(updates: DataFrame, path: str, batch_id, written_at: float | None = None) -> None:
    """Store updates (any subset of the cells, plus `updated_at`) as one batch.

    `updated_at` orders updates inside the batch; between batches the time of writing does.
    """
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    stamp = now if written_at is None else F.lit(float(written_at))
    _replace_updates(profile_rows(latest_cells(updates)).withColumn("updated_at", stamp), path, batch_id)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as error:
        raise_unless_missing(error)
        return None


def read_profiles(spark: SparkSession, path: str, without_batch=None,
                  clients: DataFrame | None = None) -> DataFrame:
    """Current profiles; an empty table where nothing is stored yet.

    A batch that runs again after a failure leaves its own earlier output out. With `clients`
    (column `ip`) only their profiles, from their buckets.
    """
    stored = _stored(spark, path)
    if stored is None:
        return spark.createDataFrame([], PROFILE)
    if without_batch is not None:
        stored = stored.filter(F.col("batch_id") != str(without_batch))
    if clients is not None:
        clients = clients.select("ip").distinct()
        buckets = [r.b for r in clients.select(bucket_of("ip").alias("b")).distinct().collect()]  # BUCKETS at most
        stored = stored.filter(F.col("bucket").isin(buckets)).join(clients, "ip", "left_semi")
    return latest_cells(stored)


def fold(spark: SparkSession, path: str, without_batch=None) -> None:
    """Replace all batches but one by a batch of their current profiles; run it between batches.

    The new batch has a name of its own and is whole before the others are deleted. A job that
    fails in between leaves cells stored twice, with equal values, and the next `fold` takes
    them in. Readers that started before the deletion have to read again.
    """
    stored = _stored(spark, path)
    if stored is None:
        return
    ids = [r.batch_id for r in stored.select("batch_id").distinct().collect()
           if r.batch_id != str(without_batch)]
    if len(ids) < 2:
        return
    earlier = stored.filter(F.col("batch_id").isin(ids))
    _replace_updates(latest_cells(earlier, F.max("updated_at").alias("updated_at")), path,
                     f"base-{uuid.uuid4().hex}")
    for batch_id in ids:
        remove(spark, f"{path}/batch_id={batch_id}")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current profiles as a new base; run it between batches and point readers and
    writers at the target afterwards."""
    stored = spark.read.schema(_STORED).parquet(path)
    _replace_updates(latest_cells(stored, F.max("updated_at").alias("updated_at")), target, "base")


def write_alerts(alert_rows: DataFrame, path: str, batch_id) -> None:
    hour = F.floor(F.col("flagged_at") / 3600).cast("bigint")
    _replace(alert_rows.withColumn("flag_hour", hour), path, batch_id, "flag_hour", "batch_id")


def read_active_alerts(spark: SparkSession, path: str, now: Column,
                       ttl: int = ALERT_TTL_SECONDS) -> DataFrame:
    """Unexpired alerts; only the hours that can hold one are read."""
    stored = spark.read.schema(_ALERTS).parquet(path)
    recent = stored.filter(F.col("flag_hour") >= F.floor((now - ttl) / 3600))
    return active_alerts(recent, now, ttl)
