"""Directions of vectors and partners of rows, against numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import directions as D


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def by_numpy(x, k):
    _, s, vh = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return vh[:k], s[:k] ** 2 / len(x), (s**2).sum() / len(x)


@pytest.mark.parametrize(("n", "width", "k"), [(400, 64, 3), (5, 64, 2), (300, 3, 3)])
def test_principal_equals_numpy(spark, n, width, k):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, width)) * np.linspace(3, 0.2, width) + 5
    got = D.principal(vectors(spark, x), "v", width, k)
    want, values, total = by_numpy(x, k)
    assert got.rows == n and np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.variances, values, rtol=1e-5) and got.total == pytest.approx(total)
    assert np.allclose(np.abs((got.vectors * want).sum(axis=1)), 1, atol=1e-3)
    along = D.principal(vectors(spark, x), "v", width, 1, reference=-got.vectors[0])
    assert along.vectors[0] @ got.vectors[0] < -0.99


def test_wide_vectors_send_no_square(spark):
    rng = np.random.default_rng(2)
    width = 3584
    main = rng.normal(size=width)
    x = rng.normal(size=(60, 1)) * main + 0.05 * rng.normal(size=(60, width))
    got = D.principal(vectors(spark, x), "v", width)
    assert abs(got.vectors[0] @ main) / np.linalg.norm(main) > 0.99 and got.shares[0] > 0.9


def test_constant_odd_and_no_vectors(spark):
    same = D.principal(vectors(spark, np.ones((4, 3))), "v", 3)
    assert same.rows == 4 and len(same.vectors) == 0 and same.total == 0
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 2.0])], "id long, v array<double>")
    got = D.principal(odd, "v", 2)
    assert got.rows == 2 and np.allclose(got.vectors, [[1.0, 0.0]])
    assert D.principal(odd.where("id > 9"), "v", 2).rows == 0


def test_directions_without_each_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6)) * [4, 2, 1, 1, 0.5, 0.1] + 1
    got = {r["id"]: (np.array(r["mean"]), np.array(r["component"])) for r in D.without_each(vectors(spark, x), "id", "v", 6).collect()}
    for i in range(30):
        others = np.delete(x, i, axis=0)
        want = by_numpy(others, 1)[0][0]
        want = want if want @ others.mean(axis=0) >= 0 else -want
        assert np.allclose(got[i][0], others.mean(axis=0)) and np.allclose(got[i][1], want, atol=1e-3)
    wide = np.outer(rng.normal(size=25) + 1, rng.normal(size=200)) + 0.02 * rng.normal(size=(25, 200))
    for r in D.without_each(vectors(spark, wide), "id", "v", 200, rank=2).collect():
        others = np.delete(wide, r["id"], axis=0)
        assert abs(np.array(r["component"]) @ by_numpy(others, 1)[0][0]) > 0.999
    few = {r["id"]: r for r in D.without_each(vectors(spark, x[:3]), "id", "v", 6).collect()}
    assert np.allclose(few[0]["component"], x[1:3].mean(axis=0))
    assert D.without_each(vectors(spark, x[:1]), "id", "v", 6).collect()[0]["mean"] is None


def test_no_row_meets_itself(spark):
    rows = [(i, "hot" if i < 300 else f"g{i // 2}" if i < 350 else None if i < 360 else f"alone{i}", float(i)) for i in range(370)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = D.partnered(df, ["g"], "id", ["x", "g"], seed=5).collect()
    assert len(got) == 370
    key = lambda i: hashlib.sha256(f"5:{i}".encode()).hexdigest()
    groups = {}
    for i, g, _ in rows:
        groups.setdefault(g, []).append(i)
    for r in got:
        order = sorted(groups[r["g"]], key=key)
        want = None if len(order) == 1 else order[(order.index(r["id"]) + 1) % len(order)]
        assert (r["other_x"], r["other_g"]) == ((None, None) if want is None else (float(want), r["g"]))


def test_percentile_of_what_is_observed(spark):
    rows = [(i, f"g{i % 3}", float(i), float(i) + (i % 5) / 10) for i in range(60)] + [(99, "alone", 1.0, 500.0), (100, "g1", None, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    near = lambda a, b: -F.abs(a - b)
    got = D.percentile_among(df, ["g"], "id", "x", "y", near, rounds=5).collect()[0]
    assert got["rows"] == 60 and got["observed"] == pytest.approx(-np.mean([(i % 5) / 10 for i in range(60)])) and got["percentile"] == 1.0
    assert got["mean_control"] < got["observed"]
    assert D.percentile_among(df, ["g"], "id", "x", "y", lambda a, b: F.abs(a - b), rounds=5).collect()[0]["percentile"] == 0.0
