"""Access-log sources: newline-delimited JSON and the keyed-object dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import parse_instant
from ..functions.numbers import to_number
from ..schemas import CANONICAL_LOG, RAW_LOG

# Names a source may use for a column; the first one present is taken. Where a log is read with
# one schema of all names, that is the first one with a value in the record.
ALIASES = {
    "path": ("path", "resource"),
    "status_code": ("status_code", "response", "status"),
    "bytes_sent": ("bytes_sent", "bytes"),
    "gt_is_robot": ("is_robot", "robot"),
}


# Every name a record may use, all read as text, so that one schema fits any log.
ANY_NAMES = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(
    [*CANONICAL_LOG.names, *RAW_LOG.names, *(n for names in ALIASES.values() for n in names)])])
LAYOUTS = {"canonical": ANY_NAMES, "raw": ANY_NAMES}


def _pick(df: DataFrame, name: str) -> Column:
    present = [c for c in ALIASES.get(name, (name,)) if c in df.columns]
    return F.col(present[0]) if present else F.lit(None)


def merged(df: DataFrame) -> DataFrame:
    """One column for all names of a column."""
    other = [n for names in ALIASES.values() for n in names]
    return df.select(*[c for c in df.columns if c not in other],
                     *[F.coalesce(*names).alias(names[0]) for names in ALIASES.values()])


def projected(df: DataFrame, *also: str) -> DataFrame:
    """Log records on the access-log columns, those without client or time included; `also` stays as it is."""
    text = lambda name: _pick(df, name).cast("string")
    return df.select(
        text("ip").alias("ip"), parse_instant(text("timestamp")).alias("ts"),
        F.coalesce(text("useragent"), F.lit("")).alias("useragent"),
        text("path").alias("path"), text("method").alias("method"),
        to_number(text("status_code"), "int").alias("status_code"),
        to_number(text("bytes_sent"), "bigint").alias("bytes_sent"),
        to_number(text("gt_is_robot"), "int").alias("gt_is_robot"), *also)


def canonical(df: DataFrame) -> DataFrame:
    """Project log records onto the access-log columns and drop those without client or time.

    `sources.intake` keeps and counts what is dropped here.
    """
    return projected(df).filter((F.col("ip") != "") & F.col("ts").isNotNull())


def with_epoch(log: DataFrame) -> DataFrame:
    """Add the whole epoch second the feature and session jobs order by."""
    return log.withColumn("epoch_s", F.unix_seconds("ts"))


def read_logs(spark: SparkSession, path: str, layout: str | None = "canonical") -> DataFrame:
    """NDJSON access logs. `layout` names the columns; None infers them with an extra pass."""
    if layout is None:
        return canonical(spark.read.json(path))
    return canonical(merged(spark.read.schema(LAYOUTS[layout]).json(path)))


def dump_body(line: Column) -> Column:
    """The JSON object in a line of the dump, empty where there is none."""
    return F.regexp_extract(line, r"^[^{]*(\{.*\})\s*,*\s*$", 1)


def dump_records(lines: DataFrame) -> DataFrame:
    """Records of a dump that is one JSON object with a record per line.

    `lines` has a text column `value`. Everything before the first brace (the record id)
    and a trailing comma are cut; lines that hold no whole record are dropped.
    """
    body = dump_body(F.col("value"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    schema = T.StructType(RAW_LOG.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.when(body != "", F.from_json(body, schema, options)).alias("r"))
    return parsed.filter("r is not null and r._corrupt is null").select(
        *[F.col(f"r.{c}").alias(c) for c in RAW_LOG.names])


def normalised(records: DataFrame) -> DataFrame:
    """Raw dump names to canonical names, whole numbers where they are numbers."""
    return records.select(
        "ip", "timestamp", "useragent", F.col("resource").alias("path"), "method",
        to_number(F.col("response"), "int").alias("status_code"),
        to_number(F.col("bytes"), "bigint").alias("bytes_sent"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The keyed-object dump as normalised records; splits by line, no conversion step."""
    return normalised(dump_records(spark.read.text(path)))


def write_ndjson(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)
