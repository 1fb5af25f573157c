"""Sparse logistic models against dense ones, and the ladder's folds, vocabularies and penalties."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling, sparse

WORDS = ["alpha", "beta", "gamma", "delta", "noise", "mild", "sharp"]


def table(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        words = list(rng.choice(WORDS, 6)) + (["signal"] * int(rng.random() < 0.8) if y else ["signal"] * int(rng.random() < 0.3))
        rows.append((i, int(i // 3), y, " ".join(words), float(rng.normal() + 0.6 * y), float(rng.normal() * 100), 7.0))
    return spark.createDataFrame(rows, "id long, grp int, y int, text string, a double, b double, flat double")


def terms_of(text):
    words = [w for w in text.lower().split() if len(w) > 1]
    chars = [f" {w} "[i : i + n] for w in text.lower().split() for n in (3, 4, 5) for i in range(max(1, len(w) + 2 - n + 1)) if len(w) + 2 >= n or n == 3]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], chars


def dense_design(rows, fold, text=True, blocks=(("a", "b", "flat"),), least=2):
    """By definition: rows by features, fitted on the rows of other folds. Columns are alphabetical within a block."""
    train = [r for r in rows if r["fold"] != fold]
    parts = []
    if text:
        cut = []
        for kind in (0, 1):
            df = Counter(t for r in train for t in set(terms_of(r["text"])[kind]))
            names = sorted(t for t, n in df.items() if n >= least)
            m = np.zeros((len(rows), len(names)))
            for i, r in enumerate(rows):
                for t, n in Counter(terms_of(r["text"])[kind]).items():
                    if t in df and df[t] >= least:
                        m[i, names.index(t)] = (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[t])) + 1)
            cut.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
        m = np.hstack(cut)
        parts.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
    for names in blocks:
        x = np.array([[r[c] for c in names] for r in rows])
        t = np.array([[r[c] for c in names] for r in train])
        sd = t.std(axis=0)
        parts.append((x - t.mean(axis=0)) / np.where(sd < 1e-12, 1.0, sd) / math.sqrt(len(names)))
    return np.hstack(parts)


def newton(x, y, c, rounds=60):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + np.eye(len(w)), c * x.T @ (p - y) + w)
    return w


@pytest.fixture(scope="module")
def dealt(spark):
    from tessera.sources.storage import stored

    return stored(sampling.stratified_group_folds(table(spark), "grp", "y", 3), "test-dealt")


@pytest.fixture(scope="module")
def by_id(dealt):
    return sorted(dealt.collect(), key=lambda r: r["id"])


def test_designs_equal_their_definition(dealt, by_id):
    rung = sparse.Rung("text", {"f": ["a", "b", "flat"]})
    rows, widths = sparse.designs(dealt, rung, id="id", label="y", fold="fold", inner=None, k=3)
    got = rows.collect()
    assert len(got) == 3 * len(by_id)
    for d in range(3):
        want = dense_design(by_id, d)
        assert sum(widths[d].values()) == want.shape[1] and list(widths[d]) == ["words", "chars", "f"]
        for r in got:
            if r["design"] == d:
                x = np.zeros(want.shape[1])
                x[r["indices"]] = r["vals"]
                assert np.allclose(x, want[[q["id"] for q in by_id].index(r["id"])], atol=1e-9)


def test_terms_are_chosen_by_occurrences(dealt, by_id):
    books = sparse.vocabularies(dealt, sparse.word_terms(F.col("text")), "fold", 3, most_terms=9)
    for d in range(3):
        train = [terms_of(r["text"])[0] for r in by_id if r["fold"] != d]
        tf, df = Counter(t for ts in train for t in ts), Counter(t for ts in train for t in set(ts))
        best = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:9]
        assert {t: i for t, (i, _) in books[d].items()} == {t: i for i, t in enumerate(sorted(best))}
        assert all(idf == pytest.approx(math.log((1 + len(train)) / (1 + df[t])) + 1) for t, (_, idf) in books[d].items())


@pytest.mark.parametrize("c", [0.01, 1.0, 10.0])
def test_fit_equals_a_dense_fit(dealt, by_id, c):
    rows, widths = sparse.designs(dealt, sparse.Rung("text", {"f": ["a", "b"]}), id="id", label="y", fold="fold", inner=None, k=3)
    totals = [sum(w.values()) for w in widths]
    got = sparse.fitted(rows, totals, [sparse.SparseFit(d, None, c) for d in range(3)], tolerance=1e-8)
    for d in range(3):
        x, y = dense_design(by_id, d, blocks=(("a", "b"),)), np.array([r["y"] for r in by_id])
        train = np.array([r["fold"] != d for r in by_id])
        assert np.allclose(got[d], newton(x[train], y[train], c), atol=2e-5)


def auc(score, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(score, y, strict=True) if p for b, q in zip(score, y, strict=True) if not q]
    return np.mean(pairs) if pairs else None


def test_ladder_chooses_in_inner_folds(dealt, by_id):
    rungs = {"O": sparse.Rung("text", {"f": ["a"]}), "H": sparse.Rung(None, {"h": ["b", "flat"]}), "O_H": sparse.Rung("text", {"f": ["a"], "h": ["b", "flat"]})}
    scores, report = sparse.ladder(dealt, rungs, id="id", label="y", group="grp", fold="fold", k=3, grid=(0.1, 2.0), inner_k=2, tolerance=1e-6)
    assert scores.columns == ["id", "y", "fold", "oof_O", "oof_H", "oof_O_H"]
    got = {r["id"]: r for r in scores.collect()}
    assert sorted(got) == [r["id"] for r in by_id] and all(got[r["id"]]["fold"] == r["fold"] for r in by_id)
    chosen = {(r["rung"], r["fold"]): r["c"] for r in report.collect()}
    assert len(chosen) == 9 and set(chosen.values()) <= {0.1, 2.0}
    y = np.array([r["y"] for r in by_id])
    for name, text, blocks in (("O", True, (("a",),)), ("H", False, (("b", "flat"),)), ("O_H", True, (("a",), ("b", "flat")))):
        for d in range(3):
            x, test = dense_design(by_id, d, text, blocks), np.array([r["fold"] == d for r in by_id])
            inner = {r["id"]: r["fold"] for r in sampling.stratified_group_folds(dealt.where(F.col("fold") != d).select("id", "y", "grp"), "grp", "y", 2).collect()}
            own = np.array([inner.get(r["id"], -1) for r in by_id])
            means = {}
            for c in (0.1, 2.0):
                found = [auc(np.hstack([x[own == g], np.ones(((own == g).sum(), 1))]) @ newton(x[(own >= 0) & (own != g)], y[(own >= 0) & (own != g)], c), y[own == g]) for g in range(2)]
                means[c] = np.mean(found)
            if abs(means[0.1] - means[2.0]) > 1e-9:
                assert chosen[name, d] == max(means, key=means.get)
            w = newton(x[~test], y[~test], chosen[name, d])
            want = np.hstack([x[test], np.ones((test.sum(), 1))]) @ w
            assert np.allclose([got[r["id"]][f"oof_{name}"] for r in by_id if r["fold"] == d], want, atol=1e-3)


def test_what_cannot_be_fitted_is_said(spark, dealt):
    with pytest.raises(ValueError, match="text or a block"):
        sparse.designs(dealt, sparse.Rung(), id="id", label="y", fold="fold", inner=None, k=3)
    rows, widths = sparse.designs(dealt, sparse.Rung(None, {"f": ["a", "b"]}), id="id", label="y", fold="fold", inner=None, k=3)
    totals = [sum(w.values()) for w in widths]
    with pytest.raises(sparse.NotConverged, match="after 2 rounds"):
        sparse.fitted(rows, totals, [sparse.SparseFit(0, None, 10.0)], rounds=2, tolerance=1e-12)
    with pytest.raises(ValueError, match="fit fewer"):
        sparse.fitted(rows, totals, [sparse.SparseFit(0, None, 1.0)], most_bytes=100)
    assert sparse.chosen_penalties(rows, totals, [0.1, 5.0], 0) == [1.0] * 3
    few = spark.createDataFrame([(i, i, int(i < 3), "", None, float("nan"), i % 3) for i in range(12)], "id long, grp int, y int, text string, a double, b double, fold int")
    scores, report = sparse.ladder(few, {"O": sparse.Rung("text", {"f": ["a", "b"]})}, id="id", label="y", group="grp", fold="fold", k=3, inner_k=5)
    assert {r["c"] for r in report.collect()} == {1.0}  # no inner folds with both classes
    assert scores.count() == 12 and not scores.where("oof_O is null or isnan(oof_O)").count()


def test_families_go_through_the_same_folds(spark):
    df = table(spark).select("id", "grp", "y", F.col("a").alias("f1_a"), F.col("b").alias("f2_b"), F.col("flat").alias("f2_flat"))
    families = {"base": sparse.prefixed(df, "f2_"), "one": sparse.prefixed(df, "f1_"), "both": sparse.prefixed(df, "f1_", "f2_")}
    assert families["both"] == ["f1_a", "f2_b", "f2_flat"]
    runs, increments = sparse.by_family(df, families, id="id", label="y", group="grp", base="base", seeds=(3, 4), k=3, rounds=30, tolerance=1e-8)
    got = {(r["family"], r["seed"]): r for r in runs.collect()}
    for seed in (3, 4):
        rows = sorted(sampling.folds(df, "grp", 3, seed).collect(), key=lambda r: r["id"])
        y = np.array([r["y"] for r in rows])
        for name, columns in families.items():
            value = np.zeros(len(rows))
            for d in range(3):
                x, test = dense_design(rows, d, False, (tuple(columns),)), np.array([r["fold"] == d for r in rows])
                value[test] = np.hstack([x[test], np.ones((test.sum(), 1))]) @ newton(x[~test], y[~test], 1.0)
            assert got[name, seed]["auroc"] == pytest.approx(auc(value, y), abs=1e-3) and (got[name, seed]["rows"], got[name, seed]["folds"]) == (len(rows), 3)
    out = {r["family"]: r for r in increments.collect()}
    mean = lambda n: np.mean([got[n, s]["auroc"] for s in (3, 4)])
    assert set(out) == {"one", "both"} and out["one"]["increment"] == pytest.approx(mean("one") - mean("base")) and out["one"]["low"] <= out["one"]["high"] and out["one"]["rows"] == 120
