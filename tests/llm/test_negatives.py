"""Hard-negative mining against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives, registry


def brute(rows, scale=256, positives=5, k=10, low=30, high=90, every=100):
    """By definition, in Python's integers. Rows are (vec_id, label, vector)."""
    ok = [(i, y, [math.floor(scale * float(np.float32(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, y, v in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c, z) for c, z, w in ok if c != i)  # noqa: B905
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [(t, c) for t, c, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            for rank, (t, c) in enumerate(inside[:k], 1):
                out[i, p, rank, c, -s, -t] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def mined(df, **options):
    return Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()))


def sample(n, spread, seed=0, labels=5, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim)) + 0.7
    rows = []
    for i in range(n):
        y = int(rng.integers(labels))
        v = centres[y] + 0.8 * rng.normal(size=dim)
        rows.append((i, y, (v / np.linalg.norm(v) * math.exp(spread * rng.normal())).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize(("spread", "lanes", "group_rows"), [(0.0, 1, 5), (1.0, 3, 4), (0.3, None, 1000)])
def test_equals_brute_force(spark, spread, lanes, group_rows):
    rows = sample(1500, spread)
    got = mined(frame(spark, rows), bucket_rows=50, group_rows=group_rows, lanes=lanes)
    assert got == brute(rows) and sum(got.values()) > 500


def test_hot_label_and_hot_vector(spark):
    rows = sample(900, 0.2)
    rows = [(i, 1 if i % 3 == 0 else y, rows[7][2] if i % 3 == 0 and i % 2 else v) for i, y, v in rows]
    assert mined(frame(spark, rows), bucket_rows=64, lanes=2) == brute(rows)


def test_nulls_ties_repeats_and_short_vectors(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0]), (3, 2, [0.5, 0.0]), (4, 2, [0.5, 0.0]), (4, 2, [0.5, 0.0]), (5, 3, [0.91, 0.0]), (6, 3, [0.3, 0.0]), (7, 3, [0.29, 0.0]),
        (8, None, [0.5, 0.0]), (None, 2, [0.5, 0.0]), (9, 2, None), (10, 2, [float("nan"), 1.0]), (11, 2, [None, 1.0]), (12, 2, [float("inf"), 1.0]), (13, 2, []), (100, 2, [0.5, 0.0]), (100, 2, [0.5, 0.0]), (200, 9, [1.0, 1.0]), (300, 3, [0.0, 0.0]),
    ]
    padded = [(i, y, v if v is None else v + [0.0] * (2 - len(v))) for i, y, v in rows]
    got = mined(frame(spark, rows))
    assert got == brute(padded)
    assert {r[1] for r in got if r[0] == 0} == {1, 2} and not [r for r in got if r[0] == 200]  # no row of its label: no positives
    assert [r for r in got if r[0] == 300]  # positives of score 0 have the window of 0 alone


def test_negative_positives_have_no_negatives(spark):
    rows = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5]), (3, 2, [0.5])]
    assert mined(frame(spark, rows)) == brute(rows) == Counter()


@pytest.mark.parametrize("size", [1.0e5, 3.0e6])
def test_large_products_are_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), (np.abs(rng.normal(size=3)) * size).astype(np.float32).tolist()) for i in range(200)]
    assert mined(frame(spark, rows), bucket_rows=30) == brute(rows)


def test_empty_one_label_and_clashing_columns(spark):
    df = frame(spark, [(0, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.2])]).withColumns({c: F.lit("x") for c in ("norm", "block", "rank", "part", "raw", "v", "score", "anchor_id")})
    assert mined(df) == Counter({(0, 1, 1, 2, 256 * 128, 256 * 51): 1})
    assert mined(df.where("vec_id < 0")) == mined(df.where("label = 1")) == mined(df.where("vec_id > 0")) == Counter()


def test_buckets_below_every_limit_are_passed_over():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(64, 4))
    m = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int32)
    ids, labels = np.arange(64), np.ones(64, np.int64)
    limits = [{"at": 0, "slot": 0, "low": 256 * 256, "high": 10**9}]
    g = negatives.Group(np.array([100]).tobytes(), np.array([2]).tobytes(), m[:1].tobytes(), 1, 4, [tuple(limits[0].values())], 1, 3)
    assert negatives._meet(g, ids.tobytes(), labels.tobytes(), m.tobytes(), 64, 4, 200.0, False) == 0
    assert negatives._meet(g, ids.tobytes(), labels.tobytes(), m.tobytes(), 64, 4, 300.0, False) == 1
    g = negatives.Group(np.array([100]).tobytes(), np.array([1]).tobytes(), m[:1].tobytes(), 1, 4, None, 1, 3)
    for _ in range(2):
        negatives._meet(g, ids.tobytes(), labels.tobytes(), m.tobytes(), 64, 4, 260.0, True)
    assert g.full[0, 0] == 3 and negatives._meet(g, ids.tobytes(), labels.tobytes(), m.tobytes(), 64, 4, 100.0, True) == 0  # its k-th best rules the shorter ones out


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows])
    assert Counter(map(tuple, registry.QUERIES["op11_hard_negatives"](spark, sf).collect())) == want
