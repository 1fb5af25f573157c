"""Ladders, reports, probes and sinks beyond what the queries show."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signals as G
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import formulas as M
from tessera.operators import ladder as L
from tessera.operators import probes as B
from tessera.operators import reports as R
from tessera.operators.contracts import ContractError
from tessera.operators.ml import _char_grams
from tessera.sources import writers
from tessera.streaming import events


def newton(a, y, c, rounds=12):
    a, w = np.c_[a, np.ones(len(a))], np.zeros(a.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) / c, a.T @ (y - p) - w / c)
    return w


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(240) < 0.4).astype(int)
    x = rng.normal(size=(240, 3)) + y[:, None] * np.array([1.0, 0.4, 0.0])
    fold = np.arange(240) % 3
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(240)], "id int, x array<double>, y int, fold int")
    return df, x, y, fold


def test_out_of_fold_values_equal_single_fits(scored):
    df, x, y, fold = scored
    rungs = L.specs({"one": 1, "two": 2})
    assert rungs == {"one": [0], "two": [1, 2], "all": [0, 1, 2]}
    got = sorted(L.out_of_fold(df, "x", "y", "fold", 3, rungs, c=2.0).collect(), key=lambda r: r["id"])
    for name, at in rungs.items():
        want = np.zeros(len(y))
        for f in range(3):
            w = newton(x[fold != f][:, at], y[fold != f], 2.0)
            want[fold == f] = np.c_[x[fold == f][:, at], np.ones((fold == f).sum())] @ w
        assert np.allclose([r[f"oof_{name}"] for r in got], want, atol=1e-6)


def test_late_fusion_is_nested(scored):
    df, x, y, fold = scored
    got = sorted(L.late_fusion(df, "x", "y", "fold", 3, [0], [1, 2]).collect(), key=lambda r: r["id"])
    want = np.zeros(len(y))
    score = lambda at, out, rows: np.c_[x[rows][:, at], np.ones(rows.sum())] @ newton(x[~np.isin(fold, out)][:, at], y[~np.isin(fold, out)], 1.0)
    for f in range(3):
        meta = np.zeros((len(y), 2))
        for j, at in enumerate(([0], [1, 2])):
            for g in range(3):
                meta[fold == g, j] = score(at, [f] if g == f else [f, g], fold == g)
        w = newton(meta[fold != f], y[fold != f], 1.0)
        want[fold == f] = np.c_[meta[fold == f], np.ones((fold == f).sum())] @ w
    assert np.allclose([r["oof_late_fusion"] for r in got], want, atol=1e-5)
    with pytest.raises(ValueError, match="three folds"):
        L.late_fusion(df, "x", "y", "fold", 2, [0], [1])


def test_penalty_is_the_first_of_the_best(scored):
    df, *_ = scored
    assert L.best_penalty(df, "x", "y", "fold", 3, [0, 1, 2], [0.01, 1.0]) in (0.01, 1.0)
    assert L.best_penalty(df.where("y = 1"), "x", "y", "fold", 3, [0], [0.5, 2.0], rounds=2) == 1.0


def test_observability_of_a_strong_and_a_weak_arm(spark):
    rows = R.synthetic(spark, 150, 2, 0.5, seed=1)
    one, two = rows, rows.withColumn("score", F.col("noise"))
    got = R.observability_gap(one, two, "group_id", "y", "score", 20).collect()[0]
    assert got["lead_one"] > 0.4 > got["lead_two"] and got["low"] <= got["gap"] <= got["high"] and got["verdict"] == "positive"
    with pytest.raises(ValueError, match="backends"):
        R.observability_gap(one, two, "group_id", "y", "score", backends=("a", "b"))


def test_character_runs_are_those_of_padded_words(spark):
    def runs(text):
        out = []
        for word in text.lower().split():
            w = f" {word} "
            for n in range(3, 6):
                if len(w) >= n:
                    out += [w[i : i + n] for i in range(len(w) - n + 1)]
        return out

    rows = spark.createDataFrame([(t,) for t in ("a bc", "Hello wörld 12", "", "x  yzzzy")], "t string")
    for r in rows.select("t", _char_grams(F.lower("t"), 3, 5).alias("g")).collect():
        assert sorted(r["g"]) == sorted(runs(r["t"]))


def test_filler_despite_other_words(spark):
    template = "Tom has [MASK] apples today."
    rows = spark.createDataFrame([("Tom has 3 apples today.",), ("TOM has: 12 big apples, today",), ("Tom has apples today.",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(X.tolerant_filler(F.lit(template), F.col("t"))).collect()]
    assert got == ["3", "12 big", None, None, None]


def test_softmax_of_wide_and_empty_arrays(spark):
    rows = spark.createDataFrame([([float(i % 7) for i in range(3000)],), ([],), ([5.0],)], "x array<double>")
    got = [r[0] for r in rows.select(V.softmax(F.col("x"))).collect()]
    e = np.exp(np.array([i % 7 for i in range(3000)]) - 6.0)
    assert np.allclose(got[0], e / e.sum()) and not got[1] and got[2] == [1.0]


def test_metadata_must_agree(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id int, a string, b int")
    assert B.agreed(a, a, ["id"], ["a", "b"]) is a
    with pytest.raises(ContractError, match="b differ"):
        B.agreed(a, a.withColumn("b", F.lit(5)), ["id"], ["a", "b"])


def test_guidance_without_scores(spark):
    rows = spark.createDataFrame([({"negative": 0.4},), ({"negative": float("nan"), "risk_positive": 1.0},), (None,), ({"negative": 0.4, "risk_positive": -0.2},)], "s map<string,double>")
    got = [r[0] for r in rows.select(B.guidance(F.col("s"), F.lit("negative"))).collect()]
    assert [g["confidence"] for g in got] == ["unknown", "unknown", "unknown", "high"] and {g["action"] for g in got} == {"no_guidance"}


def test_observability_refuses_nan(spark):
    with pytest.raises(Exception, match="not a number"):
        spark.range(1).select(G.observability(F.lit(float("nan")))).collect()


def test_formulas_of_missing_signals(spark):
    rows = spark.createDataFrame([(1, "a", "number", None, None, None, None, None, None, None), (1, "b", "object", None, 2, 0.5, float("nan"), 0.1, 0.3, 0.2)], "question_id int, span_id string, span_type string, status string, bucket int, surface double, hidden double, attention double, current double, fused double")
    got = {r["span_id"]: r["formula_scores"] for r in M.priority(rows).collect()}
    assert set(got["a"].values()) <= {0.0, 0.5} and got["b"]["surface_rule_baseline"] == 0.5 and got["b"]["B_keyness_times_fragility"] == 0.0
    assert M.priority(rows.where("question_id > 1")).count() == 0


def test_a_replaced_table_and_a_marked_log(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        writers.replaced(spark.range(n), path)
        assert writers.latest(spark, path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    got = events.marked(spark.createDataFrame([("b",), ("a",), ("a",)], "unit_id string"), "done", 7).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("a", "done", 7), ("b", "done", 8)]
    with pytest.raises(ValueError, match="none of"):
        events.marked(spark.createDataFrame([("a",)], "unit_id string"), "lost", 0)
