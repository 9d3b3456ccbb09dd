"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Settings a running session accepts; the jobs below rely on them.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot client is split also where that costs another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    # sessions of one client merge inside each input task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Settings only a new session takes.
STARTUP_SETTINGS = {
    # no Python stack trace per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # model fits that run side by side share the executors evenly
    "spark.scheduler.mode": "FAIR",
}

def build_session(app_name: str = "crawlsight", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**STARTUP_SETTINGS, **RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where it is unset a session on one machine uses a folder in its warehouse; any other raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def raise_unless_missing(error) -> None:
    """Raise a reader's error again, unless it says that nothing is stored at the path."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing is created yet."""
    return f"{scratch_root(spark)}/crawlsight/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the scratch root and read it back.

    Cuts the lineage of frames that are read many times, survives lost executors, and gives
    the planner a measured size to choose joins by.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
