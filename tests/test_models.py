"""Models on data in which one feature tells the label."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import folds as K
from strandline.operators import models as M
from strandline.operators import unitroot as U


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, a, b, a + 0.01 * r.gauss(0, 1), int(a + 0.3 * r.gauss(0, 1) > 0), 0.5 + r.random(), i % 4))
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y int, wt double, fold int").cache()


def test_components(data):
    model, k = M.components(data, ["a", "b", "c"], 0.95)
    assert k == 2 and len(model.transform(data).first()["pca"]) == 2


def test_importances(data):
    features = ["a", "b"]
    model = M.forest(data, features, trees=20)
    imp = M.impurity_importance(model, features)
    assert imp["a"][0] >= imp["b"][0] and abs(sum(v[0] for v in imp.values()) - 1) < 1e-9
    assert "a" in M.used_features(model, features)
    train, test = data.where("fold < 3"), data.where("fold = 3")
    loss = M.permutation_importance(train, test, lambda d: M.logistic(d, features), features)
    assert loss["a"] > 0.2 > abs(loss["b"]) and sorted(r[0] for r in M.permuted(test, "a").select("i").collect()) == sorted(r[0] for r in test.select("i").collect())
    alone = M.single_importance(train, test, lambda d, f: M.logistic(d, f), features)
    assert alone["a"] > 0.8 > alone["b"]
    assert M.entropy_decrease(data, "a") > 5 * M.entropy_decrease(data, "b")


def test_cross_score_and_bets(spark, data):
    folds = data.withColumnRenamed("fold", "own").crossJoin(F.broadcast(spark.range(2).withColumnRenamed("id", "fold"))).withColumn("role", F.when(F.col("own") == F.col("fold"), "test").otherwise("train"))
    scores = M.cross_score(folds, lambda d: M.logistic(d, ["a"]))
    assert set(scores) == {0, 1} and all(-0.5 < s < 0 for s in scores.values())
    p = M.probabilities(M.logistic(data, ["a"]), data).where("p between 0 and 1")
    assert p.count() == 400
    grid = data.groupBy("fold").agg(F.avg("a").alias("score")).withColumn("g", F.lit(1))
    assert M.best_of_grid(grid, ["g"], "score").count() == 1


def test_boosted_gain(data):
    gain = M.gain_importance(M.boosted(data, ["b", "a"], rounds=5), ["b", "a"])
    assert list(gain)[0] == "a" and gain["a"] > 0.7 and abs(sum(gain.values()) - 1) < 1e-9


def test_purged_validator_is_the_loop(spark, data):
    """Scores of the validator against fits one by one; a purged row trains no fold near it."""
    rows = data.drop("fold").selectExpr("*", "'s' as symbol", "cast(i as long) as i0", "cast(i + 7 as long) as i1")
    folded = rows.join(K.fold_columns(rows, 4, 0.02), ["symbol", "i0"]).cache()
    assert folded.where("size(trains) < 3").count() > 0 and folded.where("array_contains(trains, fold)").count() == 0
    _, scores = M.purged_scores(folded, ["a", "b"], (0.5, 2.0), 4)
    total = folded.agg(F.sum("wt")).first()[0]
    for c, mean, _ in scores:
        loop = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("role", F.when(F.col("fold") == F.col("k"), "test").when(F.array_contains("trains", F.col("k")), "train"))
        fit = lambda d, c=c: M.logistic(d, ["a", "b"], c=c * total / d.agg(F.sum("wt")).first()[0])
        each = M.cross_score(loop.where("role is not null"), fit, folds_col="k")
        assert mean == pytest.approx(sum(each.values()) / 4, rel=1e-6)


def test_recursive_cusum_and_adf():
    """Against regressions one by one."""
    import numpy as np

    r = np.random.default_rng(1)
    y = np.cumsum(r.standard_normal((5, 30)), axis=1)
    d, x = U.design(y, "c", 2, level=False)
    want = []
    for i in range(5):
        total = 0.0
        for t in range(3, d.shape[1]):
            b, *_ = np.linalg.lstsq(x[i, :t], d[i, :t], rcond=None)
            inv = np.linalg.pinv(x[i, :t].T @ x[i, :t])
            total += (d[i, t] - x[i, t] @ b) / np.sqrt(1 + x[i, t] @ inv @ x[i, t])
        want.append(total)
    assert np.allclose(U.recursive_cusum(y, 2), want)
    for constant in ("nc", "c", "ct", "ctt"):
        d, x = U.design(y, constant, 3)
        got = U.adf(y, constant, 3)
        for i in range(5):
            b, *_ = np.linalg.lstsq(x[i], d[i], rcond=None)
            e = d[i] - x[i] @ b
            v = e @ e / (x.shape[1] - x.shape[2]) * np.linalg.inv(x[i].T @ x[i])[0, 0]
            assert abs(got[i] - b[0] / np.sqrt(v)) < 1e-6
