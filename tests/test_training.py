"""Cross-validation side by side gives what one fit after the other gives."""

from pyspark.sql import functions as F

from crawlsight.gate import queries
from crawlsight.operators import training


def test_folds_fitted_at_once_equal_folds_in_turn(spark, monkeypatch):
    i = F.col("id")
    matrix = spark.range(120).select(
        F.concat(F.lit("k"), i).alias("ip"), (i % 3 == 0).cast("int").alias("label"),
        (i * 7 % 10 + F.when(i % 3 == 0, 4).otherwise(0)).cast("double").alias("a"), (i % 5).cast("double").alias("b"))
    candidates = {"forest": training.random_forest(["a", "b"], trees=3, depth=4),
                  "boosting": training.gradient_boosting(["a", "b"], rounds=2)}
    results, scores = [], []
    for at_once in (1, 5):
        monkeypatch.setattr(training, "AT_ONCE", at_once)
        results.append(sorted(training.compare(matrix, ["a", "b"], candidates, folds=3).collect()))
        oof = training.out_of_fold(candidates["forest"], matrix, ["a", "b"], folds=3)
        scores.append(sorted(oof.select("ip", "fold", "score").collect()))
    assert results[0] == results[1] and [r.model for r in results[0]] == ["boosting", "forest"]
    assert scores[0] == scores[1] and len(scores[0]) == 120
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_queried_scores_tell_whether_they_are_mostly_right(spark, monkeypatch):
    rows = [(f"k{i}", i % 2, 0, float(i % 2)) for i in range(20)]
    for wrong, expected in ((1, 1), (3, 0)):
        scores = spark.createDataFrame([(k, y, f, 1 - s if i < wrong else s) for i, (k, y, f, s) in enumerate(rows)],
                                       "ip string, label int, fold int, score double")
        monkeypatch.setattr(queries, "matrix_of", lambda spark, sf: None)
        monkeypatch.setattr(training, "out_of_fold", lambda *args: scores)
        found = queries.QUERIES["oof_scores"](spark, "").collect()
        assert len(found) == 20 and {(r.valid, r.mostly_right) for r in found} == {(1, expected)}


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(spark):
    i = F.col("id")
    matrix = spark.range(300).select(i.alias("ip"), (i * 13 % 7 < 3).cast("int").alias("label"),
                                     (i * 7 % 31).cast("double").alias("a"), (i % 23).cast("double").alias("b"))
    kept, walked = (training.random_forest(["a", "b"], trees=4) for _ in range(2))
    assert kept.getStages()[-1].getCacheNodeIds()
    walked.getStages()[-1].setCacheNodeIds(False)
    trees = [training.fit(p, matrix, ["a", "b"]).stages[-1].toDebugString.split("\n", 1)[1] for p in (kept, walked)]
    assert trees[0] == trees[1] and "If" in trees[0]
