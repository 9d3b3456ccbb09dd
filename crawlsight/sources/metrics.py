"""Training metrics documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRICS
from ..session import raise_unless_missing


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics documents as nested rows; an empty table where there is none."""
    try:
        return spark.read.schema(METRICS).option("multiLine", True).json(path)
    except AnalysisException as error:
        raise_unless_missing(error)
        return spark.createDataFrame([], METRICS)


def write_metrics(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def metrics_document(results: DataFrame, importances: DataFrame, counts: DataFrame,
                     best: DataFrame, features: list[str], model_version: str,
                     label: str | None = None, dataset: str | None = None) -> DataFrame:
    """One document row from evaluation rows (one per model), importances (one per feature),
    class counts and the chosen model. All inputs have a handful of rows."""
    search = F.struct("threshold", "precision", "recall", "f1")
    entry = F.struct("model", "threshold", "precision", "recall", "f1", "auc_roc",
                     search.alias("threshold_search"))
    models = results.agg(F.map_from_entries(F.collect_list(F.struct("model", entry))))
    weights = importances.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", "importance"))))
    return counts.select(
        F.lit(model_version).alias("model_version"), F.lit(label).cast("string").alias("label"),
        F.lit(dataset).cast("string").alias("dataset"),
        best.select("model").scalar().alias("best_model"),
        best.select("threshold").scalar().alias("chosen_threshold"),
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
        "n_samples", "n_robots", models.scalar().alias("models"),
        weights.scalar().alias("feature_importances"))


def model_comparison(documents: DataFrame) -> DataFrame:
    """One row per model of a document."""
    rows = documents.select("model_version", "label", "best_model", "chosen_threshold",
                            "n_samples", "n_robots", F.explode("models").alias("name", "m"))
    return rows.select("best_model", "chosen_threshold", "n_samples", "n_robots", "label",
                       F.col("name").alias("model"), "m.threshold", "m.precision", "m.recall",
                       "m.f1", "m.auc_roc")


def headline(groundtruth: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Best model and its AUC, from the ground-truth document when there is one; the version is
    that of the behaviour document when there is one."""
    def pick(df: DataFrame, rank: int, kind: str) -> DataFrame:
        return df.select(
            "best_model", F.try_element_at("models", F.col("best_model"))["auc_roc"]
            .alias("model_auc"), "model_version").withColumns(
            {"label_kind": F.lit(kind), "_rank": F.lit(rank)})

    both = pick(groundtruth, 0, "ground truth").unionByName(pick(behaviour, 1, "heuristic"))
    version = behaviour.select(F.max("model_version")).scalar()
    return both.orderBy("_rank").limit(1).drop("_rank").withColumn(
        "model_version", F.coalesce(version, "model_version"))


def feature_importances(documents: DataFrame, limit: int | None = 15) -> DataFrame:
    """Importances of a document as rows, highest first."""
    rows = (documents.select(F.explode("feature_importances").alias("feature", "importance"))
            .orderBy(F.desc("importance"), "feature"))
    return rows if limit is None else rows.limit(limit)
