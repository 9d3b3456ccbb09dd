"""Labelled sessions: two CSV feature sets joined on ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, LABEL = "ID", "ROBOT"

# Columns of the two feature sets.
SIMPLE_FEATURES = [
    "NUMBER_OF_REQUESTS", "TOTAL_DURATION", "AVERAGE_TIME", "STANDARD_DEVIATION",
    "REPEATED_REQUESTS", "HTTP_RESPONSE_2XX", "HTTP_RESPONSE_3XX", "HTTP_RESPONSE_4XX",
    "HTTP_RESPONSE_5XX", "GET_METHOD", "POST_METHOD", "HEAD_METHOD", "OTHER_METHOD", "NIGHT",
    "UNASSIGNED", "IMAGES", "TOTAL_HTML", "HTML_TO_IMAGE", "HTML_TO_CSS", "HTML_TO_JS",
    "WIDTH", "DEPTH", "STD_DEPTH", "CONSECUTIVE", "DATA", "PPI", "SF_REFERRER", "SF_FILETYPE",
    "MAX_BARRAGE", "PENALTY",
]
SEMANTIC_FEATURES = [
    "TOTAL_TOPICS", "UNIQUE_TOPICS", "PAGE_SIMILARITY", "PAGE_VARIANCE",
    "BOOLEAN_PAGE_VARIANCE",
]


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_feature_set(spark: SparkSession, folder: str, prefix: str,
                     columns: list[str] | None = None) -> DataFrame:
    """`prefix*.csv` in a folder, the first by name (a file, or a folder of files with one header);
    without `columns` the header names them. Values stay text until the model matrix converts them."""
    matches = spark.read.format("binaryFile").load(f"{folder}/{prefix}*.csv")  # names only are read
    name = F.regexp_extract("path", f"/(\\Q{prefix}\\E[^/]*\\.csv)(?:/[^/]*)?$", 1)
    first = matches.select(F.min(name)).first()[0]
    if not first:
        raise FileNotFoundError(f"no {prefix}*.csv in {folder}")
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(_schema(columns))
    return reader.csv(f"{folder}/{first}")


def join_feature_sets(simple: DataFrame, semantic: DataFrame) -> DataFrame:
    """Inner join on the id; the label is taken from the first set."""
    return simple.join(semantic.drop(LABEL), KEY, "inner")


def read_groundtruth(spark: SparkSession, folder: str) -> DataFrame:
    return join_feature_sets(read_feature_set(spark, folder, "simple_features"),
                             read_feature_set(spark, folder, "semantic_features"))
