"""Feature table: partitioned Parquet, CSV, and the reader that falls back between them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES
from ..session import raise_unless_missing


def write_features(features: DataFrame, path: str) -> None:
    """Replace the table by Parquet partitioned by date: few files per date, a huge date split
    over tasks. All dates are replaced, so a client whose last day has moved stays one row."""
    (features.hint("rebalance", F.col("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(path))


def write_features_csv(features: DataFrame, path: str) -> None:
    """CSV directory with headers, without the partition column."""
    features.drop("date").write.mode("overwrite").option("header", True).csv(path)


def typed(df: DataFrame) -> DataFrame:
    """`df` on the feature columns; missing ones are NULL."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None))
                      .cast(f.dataType).alias(f.name) for f in FEATURES.fields])


def load_features(spark: SparkSession, parquet: str, csv: str | None = None) -> DataFrame:
    """The Parquet table, else the CSV, else an empty table of the same type."""
    try:
        return typed(spark.read.parquet(parquet))
    except AnalysisException as error:
        raise_unless_missing(error)
    if csv:
        try:
            return typed(spark.read.option("header", True).csv(csv))
        except AnalysisException as error:
            raise_unless_missing(error)
    return spark.createDataFrame([], FEATURES)
