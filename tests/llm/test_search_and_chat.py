"""Exact top-k search and chat formatting."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, topk


def brute(rows, k, scale=1024):
    ok = {i: np.floor(scale * np.array(v, float)).astype(int) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ok if i % 100 == 0):
        found = []
        for i, v in ok.items():
            if i != q:
                n = max(len(v), len(ok[q]))
                found.append((-int(np.pad(ok[q], (0, n - len(ok[q]))) @ np.pad(v, (0, n - len(v)))), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(1200):
        v = centres[i % 4] + 0.05 * rng.normal(size=12)
        rows.append((i, (v / np.linalg.norm(v) * np.exp(spread * rng.normal())).astype(np.float32).tolist()))
    df = vectors(spark, rows)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, bucket_rows=100, query_rows=5, lanes=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_pruning_is_used():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(2000, 8))
    m = np.floor(1024 * m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.int32)
    b = topk.Bucket(np.arange(2000).tobytes(), m.tobytes(), 2000, 8, 8)
    found = list(topk.search_bucket(b, m[:1].astype(float), np.array([0]), np.array([1024 * 1024 * 0.99]), 10))
    assert len(found[0][1]) < 200  # coordinate bound
    assert not list(topk.search_bucket(b, m[:1].astype(float), np.array([0]), np.array([1024 * 1024 * 1.2]), 10))  # length bound


def test_nulls_ties_repeats_and_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [-1.0]), (8, []), (None, [1.0, 1.0])]
    got = [tuple(r) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024), (0, 3, 2, 1024 * 1024), (0, 4, 8, 0), (0, 5, 7, -(1024 * 1024))]


def test_empty_and_extra_columns(spark):
    df = vectors(spark, [(0, [1.0]), (100, [2.0])]).withColumns({"rank": F.lit("x"), "score": F.lit(1), "query_id": F.lit(2), "norm": F.lit(3), "lane": F.lit(4)})
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 2
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_do_not_overflow(spark):
    got = topk.top_k(vectors(spark, [(0, [1e30, 1.0]), (1, [-1e30, 1.0]), (2, [1e30, 0.0])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1]


def pairs(rows, k, scale=1024):
    """The best pairs of rows by definition, in Python's integers."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    out = []
    for q in {i for i, _ in rows if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), c) for i, u in whole if i == q for c, v in whole if c != q)
        out += [(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


def test_repeated_ids_with_other_vectors_all_count(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 300, rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    rows += rows[:5] + rows[300:320]  # and rows said twice
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, bucket_rows=64, query_rows=2, lanes=3)
    assert sorted(map(tuple, got.collect())) == pairs(rows, 10)


@pytest.mark.parametrize("size", [2.0e5, 1.0e6, 4.0e8])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (rng.normal(size=3) * size).astype(np.float32)]) for i in range(300)]
    if size > 1e7:  # products within 64 bits of components beyond 32
        rows = [(i, [v[0], 0.0, 0.0] if i % 100 else [1.0, 0.0, 0.0]) for i, v in rows]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, bucket_rows=50, query_rows=2, lanes=2)
    assert sorted(map(tuple, got.collect())) == pairs(rows, 10)


def test_largest_of_large_scores_is_first(spark):
    got = topk.top_k(vectors(spark, [(0, [400000.0, 0.0]), (1, [200000.0, 1.0]), (2, [300000.0, 1.0])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2**20 * 400000 * 300000), (1, 2**20 * 400000 * 200000)]


# ---- chat


TEXTS = ["", "plain", chat.HOSTILE, "\\", "\\\\", "###", "####", "\\###", "</turn>", "</turn></turn>\n", "### user: x</turn>\n", "a\\", "</turn", "é\U0001f600\n", " # # #"]


@pytest.mark.parametrize("role", ["user", "assistant", "a:b\n###", "", "sys\\"])
def test_round_trip(role):
    turns = [(role, t) for t in TEXTS] + [("assistant", t) for t in TEXTS]
    output, spans, texts, rewrites = chat.rendered(turns)
    assert chat.parsed(output) == turns
    assert rewrites is None
    assert [chat.unescape(output[a:b]) for a, b in texts] == [t for _, t in turns]
    assert "".join(output[a:b] for a, b in spans) == output


def test_rewriting_template_is_found():
    def last_only(turns):
        return "".join(f"[{r}]" + (t if i == len(turns) - 1 else "...") + ";" for i, (r, t) in enumerate(turns))

    assert chat.rendered([("u", "hello"), ("a", "there"), ("u", "x")], last_only)[3] == 1


def test_template_without_marks_and_with_header():
    output, spans, texts, _ = chat.rendered([("u", "ab"), ("a", "cd")], lambda ts: "<s>" + "".join(t for _, t in ts))
    assert output == "<s>abcd" and [output[a:b] for a, b in texts] == ["ab", "cd"]


def brute_digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked(turns)))


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, None, "x"), (2, None, "system", "first"), (None, 0, "user", "n"), (2**60 + 1, 0, "assistant", "y" * 50000), *[(3, i, "assistant", t) for i, t in enumerate(TEXTS)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "spans": F.lit(2)})
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(df).collect()}
    want = {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], 2: [("system", "first"), ("", "x")], None: [("user", "n")], 2**60 + 1: [("assistant", "y" * 50000)], 3: [("assistant", t) for t in TEXTS]}
    assert got == {k: brute_digest(v) for k, v in want.items()}
    assert chat.digests(df.where("conv_id = 99")).count() == 0
