"""Evaluation of scores (`score`, `label` 0/1): threshold search, AUC, model choice, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Threshold grid in hundredths, precision floor, folds.
GRID_FIRST, GRID_LAST = 30, 70
MIN_PRECISION = 0.80
FOLDS = 5
SEED = 42

_GRID = [i / 100 for i in range(GRID_FIRST, GRID_LAST + 1)]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _quality(tp: Column, predicted: Column, positives: Column) -> dict[str, Column]:
    part = lambda a, b: _or_zero(F.when(b > 0, a / b))
    return {"precision": part(tp, predicted), "recall": part(tp, positives),
            "f1": part(2 * tp, predicted + positives)}


def threshold_sweep(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Confusion counts and quality at every grid threshold, in one pass.

    A score falls into the bucket of the number of thresholds it reaches. At most 42
    bucket rows per group leave the aggregation; sums over the buckets above a threshold
    give its counts. Thresholds nothing reaches are kept with 0 predictions.
    """
    group = group or []
    reached = reduce(lambda a, b: a + b, [(F.col("score") >= t).cast("int") for t in _GRID])
    buckets = scores.groupBy(*group, reached.alias("_reached")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("label").cast("bigint").alias("_pos"))
    # per group: bucket counts as a small map, then one row per threshold
    packed = buckets.groupBy(*group).agg(
        F.collect_list(F.struct("_reached", "_n", "_pos")).alias("_buckets"),
        F.sum("_pos").alias("positives"))
    at = packed.select(*group, "positives", "_buckets", F.posexplode(
        F.array(*[F.lit(t) for t in _GRID])).alias("_i", "threshold"))
    zero = F.lit(0).cast("bigint")
    over = lambda field: F.aggregate(
        F.filter("_buckets", lambda b: b["_reached"] > F.col("_i")), zero,
        lambda acc, b: acc + b[field])
    counted = at.withColumns({"tp": over("_pos"), "predicted": over("_n")})
    return counted.withColumns(
        _quality(F.col("tp"), F.col("predicted"), F.col("positives"))
    ).select(*group, "threshold", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
             (F.col("positives") - F.col("tp")).alias("fn"), "precision", "recall", "f1")


def choose_threshold(sweep: DataFrame, group: list[str] | None = None,
                     min_precision: float = MIN_PRECISION) -> DataFrame:
    """Per group: highest recall at the precision floor, ties by precision, then by the lower
    threshold; without such a threshold the best F1; without predictions 0.5 and zeros."""
    group = group or []
    used = F.col("tp") + F.col("fp") > 0
    row = F.struct("threshold", "precision", "recall", "f1")
    low = -F.col("threshold")
    strict = F.max_by(row, F.when(used & (F.col("precision") >= min_precision),
                                  F.struct("recall", "precision", low)))
    loose = F.max_by(row, F.when(used, F.struct("f1", low)))
    nothing = F.struct(F.lit(0.5).alias("threshold"), F.lit(0.0).alias("precision"),
                       F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"))
    return (sweep.groupBy(*group).agg(F.coalesce(strict, loose, nothing).alias("c"))
            .select(*group, "c.*"))


def auc_roc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NaN for a single class.

    Scores are counted per distinct value and cut into ranges of equal size, whatever their
    distribution; values are ranked inside their range and the ranges against each other,
    so no ordered step sees all values at once.
    """
    group = group or []
    ranges = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    positive = F.sum("label").cast("bigint")
    values = (scores.groupBy(*group, "score")
              .agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))
              .repartitionByRange(ranges, *group, "score")
              .withColumn("bucket", F.spark_partition_id()))
    inside = (Window.partitionBy(*group, "bucket").orderBy("score")
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy(*group).orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("bigint")
    wide = lambda c: c.cast("decimal(19,0)")
    below = F.coalesce(F.sum("neg").over(inside), zero)
    # twice the number of (negative below positive) pairs won inside a bucket
    ranked = values.withColumn("won", wide(F.col("pos")) * wide(2 * below + F.col("neg")))
    buckets = ranked.groupBy(*group, "bucket").agg(
        F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = F.coalesce(F.sum("neg").over(across), zero)
    totals = buckets.withColumn("won", F.col("won") + wide(F.col("pos")) * wide(2 * earlier))
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    area = F.when(pairs > 0, F.col("won").cast("double") / (2 * pairs)).otherwise(
        F.lit(float("nan")))
    return (totals.groupBy(*group)
            .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .select(*group, area.alias("auc_roc")))


def evaluate(scores: DataFrame, group: str = "model") -> DataFrame:
    """One row per model: chosen threshold, quality there, AUC."""
    chosen = choose_threshold(threshold_sweep(scores, [group]), [group])
    return chosen.join(auc_roc(scores, [group]), group)


def choose_model(results: DataFrame) -> DataFrame:
    """The model with the highest recall, ties by precision, then by name."""
    return results.orderBy(F.desc("recall"), F.desc("precision"), "model").limit(1)


def assign_folds(df: DataFrame, key: str = "ip", label: str = "is_robot", folds: int = FOLDS,
                 seed: int = SEED, buckets: int = 4096) -> DataFrame:
    """Add `fold`, shuffled and stratified: the folds of a class differ by one row at most.

    Rows are ranked by hash inside hash ranges; the ranges are few and are ranked against
    each other by their counts. A class never passes through one task. The number of folds
    is at most the size of the smallest class. Reads `df` three times: give it a table.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary")))
    prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    ranged = hashed.withColumn("_b", F.floor(prefix * buckets / F.lit(2.0 ** 32)).cast("int"))
    counts = ranged.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    smallest = (counts.groupBy(label).agg(F.sum("_n").alias("_n"))
                .agg(F.greatest(F.least(F.min("_n"), F.lit(folds)), F.lit(1))))
    inside = Window.partitionBy(label, "_b").orderBy("_h", key)
    rank = F.col("_o") + F.row_number().over(inside) - 1
    return (ranged.join(offsets, [label, "_b"])
            .withColumn("fold", F.pmod(rank, smallest.scalar()).cast("int"))
            .drop("_h", "_b", "_o"))
