import math
import random

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import evaluation as ev
from crawlsight.operators import training

GRID = [i / 100 for i in range(30, 71)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def random_scores(seed, n=400, digits=2):
    rnd = random.Random(seed)
    return [(round(min(max(rnd.gauss(0.55 if y else 0.42, 0.15), 0.0), 1.0), digits), y)
            for y in (rnd.randrange(2) for _ in range(n))]


def brute_sweep(rows):
    out = {}
    for t in GRID:
        tp = sum(y for s, y in rows if s >= t)
        fp = sum(1 - y for s, y in rows if s >= t)
        fn = sum(y for s, y in rows if s < t)
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        out[t] = (tp, fp, fn, p, r, f)
    return out


def brute_choice(rows):
    best = fallback = None
    for t, (tp, fp, fn, p, r, f) in brute_sweep(rows).items():
        if tp + fp == 0:
            continue
        if fallback is None or f > fallback[3]:
            fallback = (t, p, r, f)
        if p >= 0.8 and (best is None or (r, p) > (best[2], best[1])):
            best = (t, p, r, f)
    return best or fallback or (0.5, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows", [random_scores(1), random_scores(2, digits=6), [(t, 1) for t in GRID],
                                  [(0.1, 1), (0.2, 0)], [(0.9, 0), (0.5, 0)]])
def test_sweep_and_choice(spark, rows):
    sweep = ev.threshold_sweep(scores(spark, rows))
    got = {r.threshold: tuple(r)[1:] for r in sweep.collect()}
    expected = brute_sweep(rows)
    assert set(got) == set(expected)
    for t in expected:
        assert got[t] == pytest.approx(expected[t])
    assert tuple(ev.choose_threshold(sweep).first()) == pytest.approx(brute_choice(rows))


@pytest.mark.parametrize("rows", [random_scores(3), random_scores(4, digits=7), [(0.5, 1), (0.5, 0)]])
def test_auc(spark, rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ev.auc_roc(scores(spark, rows)).first()[0] == pytest.approx(won / (len(pos) * len(neg)), abs=1e-12)


def test_auc_of_one_class_is_nan(spark):
    assert math.isnan(ev.auc_roc(scores(spark, [(0.3, 1), (0.6, 1)])).first()[0])


def test_recall_never_rises_with_the_threshold(spark):
    rows = ev.threshold_sweep(scores(spark, random_scores(5))).orderBy("threshold").collect()
    assert all(a.recall >= b.recall for a, b in zip(rows, rows[1:]))


def test_folds_are_stratified_shuffled_and_repeatable(spark):
    df = spark.range(1003).selectExpr("cast(id as string) ip", "int(id % 7 = 0) is_robot")
    folded = ev.assign_folds(df)
    sizes = folded.groupBy("is_robot", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.is_robot == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert folded.exceptAll(ev.assign_folds(df.repartition(7))).count() == 0
    few = spark.createDataFrame([(str(i), int(i < 3)) for i in range(50)], "ip string, is_robot int")
    assert ev.assign_folds(few).agg(F.max("fold")).first()[0] == 2


def test_matrix_weights_and_scaling(spark):
    df = spark.createDataFrame([("a", "1.5", 1), ("b", "x", 0), ("c", None, 0), ("d", "4.5", 0)],
                               "ip string, v string, is_robot int").withColumn("w", F.lit(7.0))
    matrix = training.model_matrix(df)
    assert training.feature_columns(df) == ["v", "w"]
    assert sorted(r.v for r in matrix.collect()) == [0.0, 0.0, 1.5, 4.5]
    weights = {r.label: r.weight for r in training.with_class_weights(matrix).collect()}
    assert weights == {1: 2.0, 0: pytest.approx(2 / 3)}
    scaled = training.scaled_columns(matrix, ["v", "w"]).collect()
    assert sum(r.v for r in scaled) == pytest.approx(0) and {r.w for r in scaled} == {0.0}
    assert sum(r.v ** 2 for r in scaled) == pytest.approx(4)


def test_models_separate_an_easy_label(spark):
    df = spark.range(400).selectExpr("cast(id as string) ip", "int(id % 4 = 0) is_robot",
                                     "is_robot * 2.0 + (id % 13) / 13.0 AS a", "(id % 17) / 17.0 AS b")
    matrix, features = training.model_matrix(df), ["a", "b"]
    results = training.compare(matrix, features, {
        "random_forest": training.random_forest(features, 5, 5),
        "gradient_boosting": training.gradient_boosting(features, 3)}, folds=2).collect()
    assert {r.model for r in results} == {"random_forest", "gradient_boosting"}
    assert all(r.auc_roc > 0.95 and r.recall > 0.9 for r in results)
    model = training.fit(training.random_forest(features, 5, 5), matrix, features)
    top = training.importances(model, features).first()
    assert top.feature == "a" and top.importance > 0.5
