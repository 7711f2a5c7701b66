"""Logistic models: optimality conditions, fold rules, and held-out predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import models as M


def data(n=240, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.2][:d] + 1
    y = (x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=n) * 0.7 > 0.8).astype(int)
    return x, y, np.array([f"chr{1 + i % 11}" for i in range(n)])


@pytest.mark.parametrize("c", [1e-4, 1.0, 100.0])
def test_fit_is_a_stationary_point(c):
    x, y, _ = data()
    w = M.fit_logistic(x, y, c)
    p = M.probability(w, x)
    assert np.abs(w[:-1] + c * x.T @ (p - y)).max() < 1e-5 * max(1, c * len(y)) and abs(c * (p - y).sum()) < 1e-5 * max(1, c * len(y))


def test_auroc_counts_ties_half():
    y, p = np.array([0, 1, 0, 1, 1]), np.array([0.1, 0.4, 0.4, 0.2, 0.9])
    assert M.auroc(y, p) == np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])


def test_quadratic_columns():
    assert M.quadratic(np.array([[2.0, 3.0]])).tolist() == [[2, 3, 4, 6, 9]]


def test_group_folds_keep_groups_whole():
    groups = np.repeat(list("abcdef"), [9, 8, 7, 2, 2, 1])
    fold = M.group_folds(groups, 3)
    assert all(len(set(fold[groups == g])) == 1 for g in "abcdef") and sorted(np.bincount(fold)) == [9, 10, 10]
    with pytest.raises(ValueError, match="too_few_groups"):
        M.group_folds(["a", "b"], 3)


@pytest.mark.parametrize("expand", [False, True])
def test_out_of_fold_equals_a_loop(spark, expand):
    x, y, g = data()
    outer = np.array([int(c[3:]) % 3 for c in g])
    rows = [("t", i, int(y[i]), x[i].tolist(), int(outer[i]), g[i], float(x[i, 0])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "task string, site int, label int, vector array<double>, fold int, chromosome string, score double").repartition(5)
    out = M.out_of_fold(df, ["task"], "site", "label", "vector", "fold", "chromosome", expand=expand).cache()
    got = {r["site"]: (r["probability"], r["penalty"]) for r in out.collect()}
    z = M.quadratic(x) if expand else x
    for k in range(3):
        train = outer != k
        w, c, table = M.search(z[train], y[train], g[train])
        assert table.shape == (7, 3) and c == M.PENALTIES[int(table.mean(1).argmax())]
        for i in np.flatnonzero(~train):
            assert abs(got[i][0] - M.probability(w, z[i : i + 1])[0]) < 1e-9 and got[i][1] == c
    table = M.fold_table(out.join(df.select("site", "score"), "site"), ["task"], "label", "fold", "score").collect()
    assert len(table) == 3 and all(r["auroc"] > 0.8 and abs(r["auroc"] - r["zero_shot_auroc"] - r["auroc_delta"]) < 1e-12 for r in table)
    with pytest.raises(ValueError, match="group_in_two_folds"):
        M.out_of_fold(df.withColumn("fold", F.col("site") % 2), ["task"], "site", "label", "vector", "fold", "chromosome")


def test_complete_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))], "a double, b double")
    assert [r["vector"] for r in M.complete_cases(df, ["a", "b"]).collect()] == [[1.0, 2.0]]
