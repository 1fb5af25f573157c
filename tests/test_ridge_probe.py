"""Multi-class probes over folds and without each row, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ridge_probe, sampling


def by_numpy(x, y, train, test, classes, alpha):
    """By definition: standard scores of training rows, a column of ones, the pseudo-inverse."""
    mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
    z = (x - mean) / np.where(sd < 1e-12, 1.0, sd)
    a = np.column_stack([z[train], np.ones(len(train))])
    penalty = np.eye(a.shape[1]) * alpha
    penalty[-1, -1] = 0
    w = np.linalg.pinv(a.T @ a + penalty) @ a.T @ np.array([[1.0 if c == k else -1.0 for k in classes] for c in y[train]])
    return np.column_stack([z[test], np.ones(len(test))]) @ w


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    y = np.array([["low", "mid", "top"][i % 3] for i in range(90)])
    x = rng.normal(size=(90, 5)) * [1, 10, 0.1, 1, 1] + np.array([["low", "mid", "top"].index(c) for c in y])[:, None] * [1, 3, 0, 0.5, 0]
    x[:, 4] = 3.0
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, str(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, label string, x array<double>")


@pytest.mark.parametrize("alpha", [0.1, 5.0])
def test_folds_equal_numpy(spark, rows, alpha):
    x, y = rows
    dealt, k = sampling.label_folds(frame(spark, x, y), "label", "id", 4)
    fold = np.array([r["fold"] for r in dealt.orderBy("id").collect()])
    got = ridge_probe.probe(dealt, key="id", label="label", fold="fold", k=k, alpha=alpha, first=("top",)).orderBy("id").collect()
    classes = ["top", "low", "mid"]
    for f in range(k):
        test = np.flatnonzero(fold == f)
        want = by_numpy(x, y, np.flatnonzero(fold != f), test, classes, alpha)
        for i, v in zip(test, want, strict=True):
            assert np.allclose([got[i]["scores"][c] for c in classes], v, atol=1e-8) and got[i]["predicted"] == classes[int(v.argmax())] and got[i]["fold"] == f
            assert got[i]["margin"] == pytest.approx(np.sort(v)[-1] - np.sort(v)[-2])
    assert np.mean([r["predicted"] == r["label"] for r in got]) > 0.6


def test_without_each_row_equals_numpy(spark, rows):
    x, y = rows[0][:30], rows[1][:30]
    got = ridge_probe.probe(frame(spark, x, y), key="id", label="label").orderBy("id").collect()
    for i in range(30):
        want = by_numpy(x, y, np.array([j for j in range(30) if j != i]), np.array([i]), ["low", "mid", "top"], 1.0)[0]
        assert np.allclose([got[i]["scores"][c] for c in ("low", "mid", "top")], want, atol=1e-8)


def test_maps_odd_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", {"p": 1.0, "q": float("nan")}), (2, "b", {"q": 2.0}), (3, None, {"r": 1.0}), (4, "a", None)], "id long, label string, m map<string,double>")
    names = ridge_probe.feature_names(df, "m")
    got = {r["id"]: r["x"] for r in ridge_probe.with_matrix(df, "m", names).collect()}
    assert names == ["p", "q", "r"] and got[1] == [1.0, 0.0, 0.0, 0.0, 1.0, 1.0] and got[2] == [0.0, 2.0, 0.0, 1.0, 0.0, 1.0]
    out = ridge_probe.probe(ridge_probe.with_matrix(df, "m", names), key="id", label="label").collect()
    assert sorted(r["id"] for r in out) == [1, 2, 4]
    assert ridge_probe.probe(df.withColumn("x", F.array(F.lit(1.0))).where("id > 9"), key="id", label="label").count() == 0
    one = ridge_probe.probe(df.withColumn("x", F.array(F.lit(1.0))).where("label = 'a'"), key="id", label="label").collect()
    assert {(r["predicted"], r["margin"]) for r in one} == {("a", None)}
    with pytest.raises(ValueError, match="different numbers"):
        ridge_probe.probe(df.withColumn("x", F.array_repeat(F.lit(1.0), F.col("id").cast("int"))), key="id", label="label")
    with pytest.raises(ValueError, match="more than 1 classes"):
        ridge_probe.probe(df.withColumn("x", F.array(F.lit(1.0))), key="id", label="label", most_classes=1)
