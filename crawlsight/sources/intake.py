"""Log intake that keeps what it refuses: accepted records, rejected lines and a ledger of both.

Every line of a source gets a verdict: accepted, or the first reason against it. Lines are written
once, partitioned by run and verdict, so a run that is repeated replaces its own rows. The ledger has
one row per run and verdict; it is counted from what is stored, not from counters of the writing
tasks, so lost executors and repeated tasks do not change it, and it outlives purged rejects.

Blank lines and the lines that only frame a dump are no records and are not counted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import raise_unless_missing, remove
from ..streaming.run import to_batches
from . import logs

ACCEPTED, MALFORMED, NO_IP, NO_TIME = "accepted", "malformed", "no_ip", "no_time"
BLANK, FRAME = r"^\s*$", r"^[\s,]*[{}]?[\s,]*$"

_PARSED = T.StructType([*logs.ANY_NAMES.fields, T.StructField("_corrupt", T.StringType())])
RECORDS = (
    "ip string, ts timestamp, useragent string, path string, method string, status_code int, bytes_sent bigint, "
    "gt_is_robot int, line string, run_id bigint, verdict string")
LEDGER = "verdict string, records bigint, run_id bigint"


def judged(lines: DataFrame, dump: bool = False) -> DataFrame:
    """Every record of text lines (column `value`): the access-log columns, `verdict`, and the line if refused."""
    body = logs.dump_body(F.col("value")) if dump else F.col("value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.filter(~F.col("value").rlike(FRAME if dump else BLANK)).select(
        F.col("value").alias("line"), (body == "").alias("no_body"), F.from_json(body, _PARSED, options).alias("r"))
    flat = parsed.select("r.*", "line", (F.col("no_body") | F.col("r").isNull() | F.col("r._corrupt").isNotNull()).alias("broken"))
    verdict = (F.when(F.col("broken"), MALFORMED).when(F.coalesce(F.col("ip"), F.lit("")) == "", NO_IP)
               .when(F.col("ts").isNull(), NO_TIME).otherwise(ACCEPTED))
    return (logs.projected(logs.merged(flat), "line", "broken").withColumn("verdict", verdict).drop("broken")
            .withColumn("line", F.when(F.col("verdict") != ACCEPTED, F.col("line"))))


class Intake:
    """Stored records, refused lines and ledger below one folder."""

    def __init__(self, spark: SparkSession, folder: str, dump: bool = False):
        self.spark, self.dump = spark, dump
        self.records_path, self.ledger_path = f"{folder}/records", f"{folder}/ledger"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            raise_unless_missing(error)
            return self.spark.createDataFrame([], schema)

    def _replace(self, df: DataFrame, path: str, *partitions: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))

    def land(self, lines: DataFrame, run_id: int) -> None:
        """Store a run's lines and its ledger rows, one for each verdict.

        What the run had stored before goes first, so a verdict that it gives no more leaves no old rows."""
        remove(self.spark, f"{self.records_path}/run_id={run_id}")
        self._replace(judged(lines, self.dump).withColumn("run_id", F.lit(run_id).cast("long")),
                      self.records_path, "run_id", "verdict")
        stored = self._read(self.records_path, RECORDS).filter(F.col("run_id") == run_id)
        counts = stored.groupBy().agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v)
                                        for v in (ACCEPTED, MALFORMED, NO_IP, NO_TIME)])
        rows = counts.unpivot([], [ACCEPTED, MALFORMED, NO_IP, NO_TIME], "verdict", "records")
        self._replace(rows.coalesce(1).withColumn("run_id", F.lit(run_id).cast("long")), self.ledger_path, "run_id")

    def records(self) -> DataFrame:
        """Accepted records on the access-log columns."""
        return self._read(self.records_path, RECORDS).filter(F.col("verdict") == ACCEPTED).drop("line", "verdict", "run_id")

    def refused(self) -> DataFrame:
        """Refused lines as they came: run_id, verdict, line."""
        return self._read(self.records_path, RECORDS).filter(F.col("verdict") != ACCEPTED).select("run_id", "verdict", "line")

    def ledger(self) -> DataFrame:
        return self._read(self.ledger_path, LEDGER).select("run_id", "verdict", "records")

    def stream(self, source: str, checkpoint: str, once: bool = False, files: int | None = None,
               archive: str | None = None) -> StreamingQuery:
        """Take in new files of a folder as they come, a micro-batch being a run.

        `files` bounds a micro-batch; finished source files move to `archive`, where one is given."""
        reader = self.spark.readStream
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        return to_batches(reader.text(source), self.land, checkpoint, once)
