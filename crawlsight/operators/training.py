"""Model training on Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import model_input
from ..session import written
from .evaluation import SEED, assign_folds, evaluate

# Columns of a feature table that are no model inputs.
NON_FEATURES = ("ip", "first_seen", "last_seen", "date", "is_robot")
TREES = 200
BOOSTING_ROUNDS = 200
LEARNING_RATE = 0.05
AT_ONCE = 5   # fits that share the cluster; one alone leaves cores idle between its many short jobs


def feature_columns(df: DataFrame, exclude=NON_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def model_matrix(df: DataFrame, key: str = "ip", label: str = "is_robot",
                 features: list[str] | None = None) -> DataFrame:
    """Key, 0/1 label and clean numeric inputs (missing, bad and infinite values are 0)."""
    features = features or feature_columns(df, {*NON_FEATURES, key, label})
    return df.select(key, F.col(label).cast("int").alias("label"),
                     *[model_input(F.col(c)).alias(c) for c in features])


def scaled_columns(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Standardised inputs as plain columns, by the population deviation (0 where constant)."""
    stats = matrix.agg(*[F.avg(c).alias(f"_m_{c}") for c in features],
                       *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    row = stats.select(F.struct("*").alias("s")).scalar()
    with_stats = matrix.withColumn("_s", row)
    return with_stats.withColumns({
        c: F.coalesce(
            (F.col(c) - F.col(f"_s._m_{c}")) / F.nullif(F.col(f"_s._s_{c}"), F.lit(0.0)),
            F.lit(0.0)) for c in features}).drop("_s")


def with_class_weights(matrix: DataFrame) -> DataFrame:
    """Add `weight` = rows / (2 * rows of the class)."""
    counts = matrix.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    row = counts.select(F.struct("*").alias("c")).scalar()
    size = F.when(F.col("label") == 1, F.col("_c.pos")).otherwise(F.col("_c.n") - F.col("_c.pos"))
    return matrix.withColumn("_c", row).withColumn("weight", F.col("_c.n") / (2 * size)).drop("_c")


def _pipeline(features: list[str], classifier) -> Pipeline:
    # the assembler reads the prefixed inputs that scoring also provides
    assemble = VectorAssembler(inputCols=[f"_in_{c}" for c in features], outputCol="features_raw")
    scale = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True)
    return Pipeline(stages=[assemble, scale, classifier])


def random_forest(features: list[str], trees: int = TREES, depth: int = 20, seed: int = SEED) -> Pipeline:
    """Class-balanced forest.

    The node of a row in every tree is kept from level to level (4 bytes a tree), so that a pass does
    not walk deep trees from their roots; the fitted trees are the same.
    """
    return _pipeline(features, RandomForestClassifier(
        numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed, cacheNodeIds=True))


def gradient_boosting(features: list[str], rounds: int = BOOSTING_ROUNDS,
                      rate: float = LEARNING_RATE, seed: int = SEED) -> Pipeline:
    return _pipeline(features, GBTClassifier(
        maxIter=rounds, stepSize=rate, maxDepth=3, seed=seed))


def _inputs(matrix: DataFrame, features: list[str]) -> DataFrame:
    return with_class_weights(matrix.withColumns({f"_in_{c}": F.col(c) for c in features}))


def fit(pipeline: Pipeline, matrix: DataFrame, features: list[str]) -> PipelineModel:
    return pipeline.fit(_inputs(matrix, features))


def probabilities(model: PipelineModel, matrix: DataFrame, features: list[str],
                  key: str) -> DataFrame:
    """Robot probability per row as `score`."""
    kept = [key, "label"] + (["fold"] if "fold" in matrix.columns else [])
    inputs = matrix.withColumns({f"_in_{c}": F.col(c) for c in features})
    return model.transform(inputs).select(*kept, vector_to_array("probability")[1].alias("score"))


def _at_once(spark: SparkSession, jobs: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """What the jobs return, in their order; AT_ONCE of them run side by side, each in a scheduler pool of its own."""
    def run(numbered: tuple[int, Callable[[], DataFrame]]) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{numbered[0] % AT_ONCE}")
        return numbered[1]()

    with ThreadPoolExecutor(AT_ONCE) as threads:
        return list(threads.map(inheritable_thread_target(spark)(run), enumerate(jobs)))


def _fold_jobs(pipeline: Pipeline, folded: DataFrame, present: list[int], features: list[str],
               key: str) -> list[Callable[[], DataFrame]]:
    """One fit per fold, which scores the rows it has not seen."""
    def job(k: int) -> Callable[[], DataFrame]:
        return lambda: probabilities(fit(pipeline.copy(), folded.filter(F.col("fold") != k), features),
                                     folded.filter(F.col("fold") == k), features, key)

    return [job(k) for k in present]


def _folded(matrix: DataFrame, key: str, folds: int, seed: int) -> tuple[DataFrame, list[int]]:
    """The matrix with its folds, written once for all fits, and which folds there are."""
    folded = written(assign_folds(matrix, key, "label", folds, seed), "folds")
    return folded, sorted(r.fold for r in folded.select("fold").distinct().collect())  # at most `folds`


def out_of_fold(pipeline: Pipeline, matrix: DataFrame, features: list[str], key: str = "ip",
                folds: int = 5, seed: int = SEED) -> DataFrame:
    """Probability of every row from the model that did not see its fold.

    One fit per fold, each distributed, all over one stored matrix and side by side.
    """
    folded, present = _folded(matrix, key, folds, seed)
    return reduce(DataFrame.unionByName,
                  _at_once(matrix.sparkSession, _fold_jobs(pipeline, folded, present, features, key)))


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """Feature importances, highest first; one row per feature."""
    spark = SparkSession.active()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def compare(matrix: DataFrame, features: list[str], candidates: dict[str, Pipeline],
            key: str = "ip", folds: int = 5) -> DataFrame:
    """Cross-validated evaluation of every candidate, one row each; all share their folds and are fitted side by side."""
    folded, present = _folded(matrix, key, folds, SEED)
    jobs = {name: _fold_jobs(p, folded, present, features, key) for name, p in candidates.items()}
    parts = _at_once(matrix.sparkSession, [job for fits in jobs.values() for job in fits])
    names = [name for name, fits in jobs.items() for _ in fits]
    scores = [part.withColumn("model", F.lit(name)) for name, part in zip(names, parts)]
    return evaluate(written(reduce(DataFrame.unionByName, scores), "scores"))
