"""The event log: scored requests, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, network

EVENT_LOG = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ip", T.StringType()),
    T.StructField("timestamp", T.DoubleType()), T.StructField("path", T.StringType()),
    T.StructField("useragent", T.StringType()), T.StructField("risk_score", T.DoubleType()),
    T.StructField("is_bot", T.IntegerType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("bytes_sent", T.LongType()), T.StructField("session_id", T.StringType()),
    T.StructField("cidr_block", T.StringType()),
])


def event_rows(scored: DataFrame) -> DataFrame:
    """Event-log rows of scored requests.

    Missing optional columns are NULL, a missing time is the time of the run, an unknown
    verdict stays unknown. Requests without an address have no place in the log.
    """
    columns = scored.columns
    pick = lambda c: (F.col(c) if c in columns else F.lit(None)).cast(EVENT_LOG[c].dataType)
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    rows = scored.filter(F.col("ip").isNotNull()).select(
        *[pick(f.name).alias(f.name) for f in EVENT_LOG.fields[:9]])
    rows = rows.withColumn("timestamp", F.coalesce("timestamp", now))
    return rows.withColumns({
        "session_id": network.session_bucket_id(F.col("ip"), F.col("timestamp")),
        "cidr_block": network.subnet24(F.col("ip")),
    })


def append_events(scored: DataFrame, path: str, batch_id: str | int = 0) -> None:
    """Append scored requests as one batch; writing a batch again replaces it."""
    day = F.to_date(clock.as_instant(F.col("timestamp")))
    (event_rows(scored).withColumn("event_date", day).withColumn("batch_id", F.lit(str(batch_id)))
     .hint("rebalance", F.col("event_date"))  # few files per day, a huge day split
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "batch_id").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log; filters on `event_date` prune whole days."""
    schema = T.StructType(EVENT_LOG.fields + [T.StructField("event_date", T.DateType()),
                                              T.StructField("batch_id", T.StringType())])
    return spark.read.schema(schema).parquet(path)
