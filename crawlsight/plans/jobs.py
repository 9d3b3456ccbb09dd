"""Batch jobs: log preparation, features, training, profile seeding, checks.

    python -m crawlsight.plans.jobs prepare --input dump.json --output log
    python -m crawlsight.plans.jobs features --input log --output tables
    python -m crawlsight.plans.jobs train --input tables/features.parquet --output models
    python -m crawlsight.plans.jobs train-groundtruth --input raw --output models-gt
    python -m crawlsight.plans.jobs seed --input tables/features.parquet --output profiles
"""

from __future__ import annotations

import argparse
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import evaluation, features as feat, profiles, rollups, training
from ..session import build_session, raise_unless_missing, remove, written
from ..sources import (features as feature_table, groundtruth, logs, metrics,
                       profiles as profile_store)

DUMP, NDJSON, PREPARED = "dump", "ndjson", "prepared"


def _text_log(spark: SparkSession, source: str, layout: str) -> DataFrame:
    if layout == DUMP:
        return logs.canonical(logs.read_dump(spark, source))
    return logs.read_logs(spark, source)


def layout_of(spark: SparkSession, source: str) -> str:
    """What a file or folder holds, by its name's ending; text by its first line: a line of NDJSON
    is one whole object. A folder without an ending counts as a prepared log."""
    if not source.rstrip("/").endswith((".ndjson", ".json", ".jsonl", ".gz", ".txt")):
        return PREPARED
    first = spark.read.text(source).filter(F.trim("value") != "").first()
    line = first["value"].strip() if first else "{}"
    return NDJSON if line.startswith("{") and line.endswith("}") else DUMP


def prepare(spark: SparkSession, source: str, target: str, layout: str = DUMP,
            batch_id: str | None = None) -> None:
    """Add a dump or NDJSON log to a Parquet access log partitioned by day and batch.

    Later jobs then read only the columns they use. A batch is a source, or what `batch_id` names:
    other batches stay as they are, and one that is prepared again is replaced, days that it no longer
    has included. Every request gets an `event_id` above those of all other batches. Rows carry the run
    that wrote them; what an earlier run of the batch left is removed once the new rows are stored. A
    job that dies in between leaves both, and the next run of the batch removes them.
    """
    batch, run = "b-" + hashlib.md5((batch_id or source).encode()).hexdigest(), uuid.uuid4().hex
    first_id = 0
    try:
        stored = spark.read.parquet(target).filter(F.col("batch_id") != batch)
        first_id = stored.agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).first()[0]
    except AnalysisException as error:
        raise_unless_missing(error)
    rows = logs.with_epoch(_text_log(spark, source, layout)).withColumns({
        "event_id": F.monotonically_increasing_id() + F.lit(first_id).cast("long"), "run_id": F.lit(run),
        "day": F.to_date("ts"), "batch_id": F.lit(batch)})
    (rows.hint("rebalance", F.col("day")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(target))
    _remove_other_runs(spark, target, batch, run)


def _remove_other_runs(spark: SparkSession, target: str, batch: str, run: str) -> None:
    """Delete the batch's days that `run` did not write."""
    try:
        stored = spark.read.schema("run_id string, day string, batch_id string").parquet(target)
    except AnalysisException as error:
        return raise_unless_missing(error)  # a first batch without a single row
    left = stored.filter((F.col("batch_id") == batch) & ~F.col("run_id").eqNullSafe(F.lit(run)))
    for row in left.select("day").distinct().collect():
        remove(spark, f"{target}/day={row['day']}/batch_id={batch}")


def read_log(spark: SparkSession, source: str, layout: str | None = None) -> DataFrame:
    """A prepared log, or a dump or NDJSON (file or folder) read on the fly."""
    layout = layout or layout_of(spark, source)
    if layout == PREPARED:
        return spark.read.parquet(source).drop("run_id")
    return logs.with_epoch(_text_log(spark, source, layout))


def build_features(spark: SparkSession, source: str, target: str, layout: str | None = None) -> DataFrame:
    """Features of a log as Parquet by date and as CSV; the CSV is written from the Parquet."""
    path = f"{target}/features.parquet"
    feature_table.write_features(feat.ip_features(read_log(spark, source, layout)), path)
    table = feature_table.load_features(spark, path)
    feature_table.write_features_csv(table, f"{target}/features.csv")
    return table


def _train(spark: SparkSession, matrix: DataFrame, features: list[str], target: str, key: str,
           trees: int, rounds: int, folds: int, label: str | None, dataset: str | None) -> DataFrame:
    matrix = written(matrix, "matrix")
    candidates = {"random_forest": training.random_forest(features, trees),
                  "gradient_boosting": training.gradient_boosting(features, rounds)}
    results = written(training.compare(matrix, features, candidates, key, folds), "results")
    best = evaluation.choose_model(results)
    winner = best.first()["model"]
    model = training.fit(candidates[winner], matrix, features)
    model.write().overwrite().save(f"{target}/model")
    document = metrics.metrics_document(
        results, training.importances(model, features),
        rollups.class_balance(matrix, "label"), best, features, profiles.MODEL_VERSION, label, dataset)
    metrics.write_metrics(document, f"{target}/metrics")
    return metrics.read_metrics(spark, f"{target}/metrics")


def train(spark: SparkSession, features_path: str, target: str, trees: int = training.TREES,
          rounds: int = training.BOOSTING_ROUNDS, folds: int = evaluation.FOLDS) -> DataFrame:
    """Compare both models by cross-validation, refit and store the better one with its metrics."""
    table = feature_table.load_features(spark, features_path)
    features = training.feature_columns(table)
    return _train(spark, training.model_matrix(table, features=features), features, target, "ip",
                  trees, rounds, folds, None, None)


def train_groundtruth(spark: SparkSession, folder: str, target: str, trees: int = training.TREES,
                      rounds: int = training.BOOSTING_ROUNDS,
                      folds: int = evaluation.FOLDS) -> DataFrame:
    """The same on labelled sessions."""
    rows = groundtruth.read_groundtruth(spark, folder)
    key, label = groundtruth.KEY, groundtruth.LABEL
    features = training.feature_columns(rows, (key, label))
    return _train(spark, training.model_matrix(rows, key, label, features), features, target, key,
                  trees, rounds, folds, "ground_truth_ROBOT", "simple and semantic session features")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, float, str]:
    """Stored model, its threshold and version."""
    row = metrics.read_metrics(spark, f"{folder}/metrics").select(
        "chosen_threshold", "model_version").first()
    return PipelineModel.load(f"{folder}/model"), row["chosen_threshold"], row["model_version"]


def seed(spark: SparkSession, features_path: str, target: str, models: str | None = None) -> None:
    """Score a feature table and store it as profiles; by rule where there is no model."""
    table = feature_table.load_features(spark, features_path)
    model, threshold, version = (load_model(spark, models) if models
                                 else (None, verdicts.DEFAULT_THRESHOLD, profiles.RULES_VERSION))
    rows = profiles.seed_profiles(table, model, threshold, version)
    profile_store.write_updates(rows.withColumn("updated_at", F.lit(0.0)), target, "seed")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["prepare", "features", "train", "train-groundtruth", "seed"])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--layout", choices=[DUMP, NDJSON, PREPARED],
                        help="of the input; found out where it is left away")
    parser.add_argument("--models", help="folder of a trained model, for seed")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.job == "prepare":
        prepare(spark, args.input, args.output, args.layout or layout_of(spark, args.input))
    elif args.job == "features":
        build_features(spark, args.input, args.output, args.layout)
    elif args.job == "train":
        train(spark, args.input, args.output)
    elif args.job == "train-groundtruth":
        train_groundtruth(spark, args.input, args.output)
    else:
        seed(spark, args.input, args.output, args.models)


if __name__ == "__main__":
    main()
