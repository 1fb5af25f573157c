"""Contracts, joins, samples, statistics, models, log and files on small tables."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import contracts as K
from tessera.operators import joins as J
from tessera.operators import ml as M
from tessera.operators import ranking as G
from tessera.operators import sampling as P
from tessera.operators import spans as S
from tessera.operators import stats as T
from tessera.functions import text as X
from tessera.sources import readers, tensors, writers
from tessera.streaming import events as E


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- contracts


def test_schema_guards(spark):
    df = frame(spark, [(1, (2, [(3,)]))], "a int, b struct<c:int,d:array<struct<gold_answer:int>>>")
    assert K.field_paths(df.schema) == ["a", "b", "b.c", "b.d", "b.d[].gold_answer"]
    with pytest.raises(K.ContractError):
        K.no_leakage(df, ["gold_answer"])
    with pytest.raises(K.ContractError):
        K.no_leakage(df, ["gold"], parts=True)
    K.no_leakage(df, ["gold"])
    with pytest.raises(K.ContractError):
        K.require(df, ["a", "z"])
    with pytest.raises(K.ContractError):
        K.forbid(df, ["a"])


def test_rules(spark):
    df = frame(spark, [(1, "x", 0.5), (2, " ", 2.0), (3, None, float("nan"))], "id int, t string, s double")
    rules = {"t": K.filled(F.col("t")), "s": K.between(F.col("s"), 0, 1)}
    good, bad = K.split(df, rules)
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["violations"] for r in bad.collect()} == {2: ["t", "s"], 3: ["t", "s"]}
    assert {r["rule"]: r["rows"] for r in K.violation_counts(df, rules).collect()} == {"t": 2, "s": 2}
    assert K.enforce(good, rules, "id").count() == 1
    with pytest.raises(Exception, match="contract broken"):
        K.enforce(df, rules, "id").collect()


def test_dates_and_spans(spark):
    df = frame(spark, [("2024-02-29",), ("2024-02-30",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(F.coalesce(K.is_date(F.col("d")), F.lit(False))).collect()] == [True, False, False, False]
    df = frame(spark, [("abc", [("b", 1, 2)]), ("abc", [("c", 1, 2)]), ("abc", [])], "t string, s array<struct<text:string,start:int,end:int>>")
    assert [r[0] for r in df.select(K.spans_fit(F.col("t"), F.col("s"))).collect()] == [True, False, True]


# ---- joins


def test_strict_join(spark):
    a, b = frame(spark, [(1, "x"), (1, "y"), (2, "z")], "k int, v string"), frame(spark, [(1, 10), (2, 20)], "k int, w int")
    assert J.strict_join(a, b, ["k"]).count() == 3
    with pytest.raises(K.ContractError):
        J.strict_join(a, b.where("k = 1"), ["k"])
    with pytest.raises(K.ContractError):
        J.strict_join(b, a, ["k"])
    with pytest.raises(K.ContractError):
        J.strict_join(a, b, ["k"], one_to_one=True)


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_overlaps(spark, width):
    rng = random.Random(width)
    make = lambda n: [(rng.randrange(2), i, s, s + rng.randrange(0, 12)) for i, s in enumerate(rng.choices(range(60), k=n))]
    a, b = make(40), make(40)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    l, r = frame(spark, a, "k int, i int, start int, end int"), frame(spark, b, "k int, j int, start int, end int")
    assert sorted((x["i"], x["r_j"]) for x in J.overlaps(l, r, ["k"], width=width).collect()) == want


def test_concordance_without_groups(spark):
    rng = random.Random(0)
    rows = [(rng.choice([0.1, 0.2, 0.3]), rng.randrange(3)) for _ in range(60)]
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for (a, s), (b, t) in itertools.product(rows, rows) if s > t]
    got = G.concordance(frame(spark, rows, "s double, t int"), [], "s", "t").collect()[0]
    assert got["pairs"] == len(won) and abs(got["concordance"] - np.mean(won)) < 1e-12


def test_global_row_number(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    got = G.global_row_number(frame(spark, rows, "v int").repartition(7), [F.asc("v")], "r").collect()
    assert sorted((r["v"], r["r"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert G.global_row_number(frame(spark, [], "v int"), [F.asc("v")], "r").count() == 0


# ---- samples


def test_samples_and_splits(spark):
    df = frame(spark, [(i, f"g{i % 13}", i % 3 == 0) for i in range(200)], "id int, g string, y boolean")
    assert P.sample(df, "id", 20, 1).count() == 20 and sorted(P.sample(df, "id", 20, 1).collect()) == sorted(P.sample(df.repartition(5), "id", 20, 1).collect())
    assert P.quota(df, ["g"], "id", 2).count() == 26
    assert P.quota_then_fill(df, ["g"], "id", 2, 50).count() == 50
    split = P.group_split(df, "g", {"a": 0.5, "b": 0.25, "c": 0.25})
    assert A.group_leakage(split, "g", "split").count() == 0 and split.count() == 200
    folds = P.stratified_group_folds(df, "g", "y", 3)
    assert folds.count() == 200 and A.group_leakage(folds, "g", "fold").count() == 0
    assert all(0 < r["p"] < r["n"] for r in folds.groupBy("fold").agg(F.sum(F.col("y").cast("int")).alias("p"), F.count("*").alias("n")).collect())
    with pytest.raises(ValueError):
        P.stratified_group_folds(df.withColumn("y", F.lit(True)), "g", "y", 3)
    runs, state = P.dealt_profiles([(2, 5, 10**9), (1, 1, 7), (0, 3, 10**9 + 1), (0, 1, 2)], 4)
    assert sum(n for *_, n, _ in runs) == 2 * 10**9 + 10 and len(runs) < 20
    assert max(p for p, _ in state) - min(p for p, _ in state) <= 1 and max(n for _, n in state) - min(n for _, n in state) <= 3
    for seed in range(20):
        sizes = [((seed * 7 + i * i) % 4, 4 + i % 3) for i in range(60)]
        one = [[0, 0] for _ in range(3)]  # group after group
        for p, n in sorted(sizes, reverse=True):
            f = min(range(3), key=lambda i, p=p: (*(one[i] if p else one[i][::-1]), i))
            one[f] = [one[f][0] + p, one[f][1] + n]
        assert P.dealt_profiles([(*s, sizes.count(s)) for s in set(sizes)], 3)[1] == [tuple(x) for x in one]
    labelled = frame(spark, [(i, "abc"[min(i % 7, 2)]) for i in range(140)] + [(999, None)], "id int, label string")
    dealt, k = P.label_folds(labelled, "label", "id", 4)
    counts = dealt.groupBy("label", "fold").count().collect()
    assert k == 4 and dealt.count() == 140 and len(counts) == 12 and all(max(r["count"] for r in counts if r["label"] == x) - min(r["count"] for r in counts if r["label"] == x) <= 1 for x in "abc")
    assert P.label_folds(labelled.where("id < 16"), "label", "id", 5)[1] == 3 and P.label_folds(labelled.where("id < 2"), "label", "id")[1] == 2
    assert sorted(r["fold"] for r in P.label_folds(labelled.where("id < 9"), "label", "id")[0].collect()) == [0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert sorted(r["fold"] for r in P.label_folds(labelled.where("id < 7"), "label", "id")[0].collect()) == list(range(7))
    assert P.label_folds(labelled.where("id > 999"), "label", "id")[1] == 0
    assert P.whole_groups(df, "g", 31).count() == 31
    sizes = [r["n"] for r in P.stratified_folds(df, "y", "id", 4).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) < 70
    shuffled = df.limit(1).select(P.shuffled_choices(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("id"), 3).alias("c")).collect()[0]["c"]
    assert [c["label"] for c in shuffled] == ["A", "B", "C"] and sorted(c["choice"] for c in shuffled) == ["a", "b", "c"]
    assert P.fold_ladder(4) == 3 and P.fold_ladder(1) == 0
    assert P.config_grid(spark, [{"a": [1, 2], "b": [3]}, {"a": [1], "b": [3]}, {"a": [5]}]).count() == 3


# ---- statistics


def test_auroc_single_class(spark):
    df = frame(spark, [(0.1, 1), (0.2, 1), (None, 0)], "s double, y int")
    assert T.auroc(df, "s", "y").collect()[0]["auroc"] is None


def test_bootstrap_interval_methods(spark):
    df = frame(spark, [(float(i),) for i in range(41)], "v double")
    linear = T.interval(df, "v").collect()[0]
    assert np.allclose([linear["low"], linear["high"]], [1.0, 39.0])
    assert T.interval(df, "v", method="rank").collect()[0]["low"] == 1.0
    assert T.interval(df, "v", method="count").collect()[0]["high"] == 39.0


def test_multiplicity_is_poisson(spark):
    m = spark.range(20000).select(T.multiplicity(F.col("id"), F.lit(1), 5).alias("m"))
    r = m.agg(F.avg("m"), F.var_pop("m")).collect()[0]
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05


def test_paired_bootstrap_verdict(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 40}", int(y), float(rng.normal()), float(y + 0.3 * rng.normal())) for i, y in enumerate(rng.integers(0, 2, 400))]
    r = T.paired_bootstrap(frame(spark, rows, "g string, y int, base double, other double"), "g", "y", "base", "other", rounds=40).collect()[0]
    assert r["verdict"] == "positive" and r["low"] > 0.2


def test_temperature(spark):
    df = frame(spark, [([0.0, float(i)], i) for i in range(5)], "l array<double>, t int")
    assert T.calibrated_temperature(df, "l", "t", [0.5, 1.0]).collect()[0]["spearman"] == 1.0


# ---- models


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.normal(size=80)
    df = frame(spark, [(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    z = np.c_[x, np.ones(80)]
    want = np.linalg.solve(z.T @ z + np.diag([2.0, 2, 2, 0]), z.T @ y)
    assert np.allclose(M.ridge(df, ["a", "b", "c"], F.col("y"), 2.0), want)


def test_logistic_is_stationary(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    w = M.logistic(frame(spark, [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, y int"), ["a", "b"], "y", c=1.0)
    z = np.c_[x, np.ones(200)]
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w))) - w).max() < 1e-6


def test_ridge_classes(spark):
    df = frame(spark, [(float(i % 3), ["a", "b", "c"][i % 3]) for i in range(30)], "x double, y string").withColumn("x2", F.col("x") * F.col("x"))
    models = M.ridge_classes(df, ["x", "x2"], "y", 1e-6)
    assert df.where(M.predicted_class(["x", "x2"], models) == F.col("y")).count() == 30


def test_isotonic(spark):
    fit = M.isotonic([(1, 1, 1), (2, 3, 1), (3, 2, 1), (4, 4, 1), (4, 6, 1)])
    assert fit == [(1, 1), (2, 2.5), (3, 2.5), (4, 5)]
    df = frame(spark, [(float(i), float(i % 2 or i > 5)) for i in range(10)], "s double, y double")
    values = [r["calibrated"] for r in M.isotonic_calibrated(df, "s", "y", train=F.lit(True)).orderBy("s").collect()]
    assert values == sorted(values)


def test_isotonic_is_exact_at_any_size(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=4000), np.repeat(rng.normal(size=20), 50), [-9.0, 9.0]])
    rows = [(i, float(v), float(rng.random() < 1 / (1 + np.exp(-v))), bool(i % 3)) for i, v in enumerate(x)] + [(-1, None, 1.0, True), (-2, 0.5, None, True), (-3, float("nan"), None, False)]
    xs, ys = zip(*M.isotonic([(v, y, 1.0) for _, v, y, t in rows if t and v is not None and y is not None]), strict=True)
    assert len(xs) > 2000
    out = M.isotonic_calibrated(frame(spark, rows, "i long, s double, y double, t boolean").repartition(7), "s", "y", train=F.col("t"))
    got = {r["i"]: r["calibrated"] for r in out.collect()}
    assert len(got) == len(rows) and got[-1] is None and got[-3] == pytest.approx(ys[-1])
    want = np.interp([v for _, v, _, _ in rows[:-3]], xs, ys)
    assert np.allclose([got[i] for i, *_ in rows[:-3]], want, rtol=0, atol=1e-9)
    rising = frame(spark, [(float(i), float(i * i)) for i in range(3000)], "s double, y double")
    assert all(r["calibrated"] == r["y"] for r in M.isotonic_calibrated(rising, "s", "y", train=F.lit(True)).collect())
    assert {r["calibrated"] for r in M.isotonic_calibrated(rising, "s", "y", train=F.lit(False)).collect()} == {None}


def test_first_component(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 1)) * [3.0, 4.0, 0.0] + 0.01 * rng.normal(size=(100, 3))
    direction, share = M.first_component(frame(spark, [(r.tolist(),) for r in x], "v array<double>"), "v", 3)
    assert np.allclose(direction, [0.6, 0.8, 0.0], atol=0.01) and share > 0.99


def test_tfidf_rows_have_length_one(spark):
    df = frame(spark, [(1, "red blue red"), (2, "blue green"), (3, "red green"), (4, "")], "id int, t string")
    rows = M.tfidf(df, "id", "t").collect()
    for i in (1, 2, 3):
        assert abs(sum(r["weight"] ** 2 for r in rows if r["id"] == i) - 1) < 1e-9
    assert {r["term"] for r in rows} == {"red", "blue", "green"}


def test_matrix_fills_missing(spark):
    df = frame(spark, [(1, {"a": 1.0, "b": float("nan")}), (2, {"b": 2.0})], "id int, f map<string,double>")
    got = {(r["id"], r["feature"]): (r["value"], r["is_missing"]) for r in M.matrix(df, "id", "f").collect()}
    assert got == {(1, "a"): (1.0, 0), (1, "b"): (0.0, 1), (2, "a"): (0.0, 1), (2, "b"): (2.0, 0)}


# ---- spans


def test_unoverlapped_and_parents(spark):
    rows = [("q", 0, 5, "number", "12345"), ("q", 3, 8, "object", "45abc"), ("q", 0, 10, "entity", "whole"), ("q", 20, 22, "number", "99"), ("q", 20, 22, "number", "99")]
    got = S.unoverlapped(frame(spark, rows, "q string, start int, end int, type string, text string"), "q").collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 5), (0, 10), (20, 22)]
    spans = frame(spark, [("q", "a", 0, 10), ("q", "b", 2, 5), ("q", "c", 8, 12), ("q", "d", 12, 13)], "q string, span_id string, start int, end int")
    got = {r["span_id"]: (r["overlap_group"], r["parent"]) for r in S.parents(spans, "q").collect()}
    assert got == {"a": (1, None), "b": (1, "a"), "c": (1, None), "d": (2, None)}


def test_unoverlapped_keeps_families_and_nests_numbers_only(spark):
    kinds = ["number"] * 10 + ["question_target"] * 2 + ["object"] * 2 + ["negation", "comparison"]
    rows = [("q", 10 * i, 10 * i + 5, t, f"w{i}") for i, t in enumerate(kinds)]
    rows += [("p", 0, 20, "entity", "outer"), ("p", 5, 9, "object", "inner"), ("p", 30, 40, "object", "3 apples"), ("p", 30, 31, "number", "3")]
    rows += [("r", 10 * i, 10 * i + 5, t, f"v{i}") for i, t in enumerate(["entity"] * 12 + ["object"] * 3 + ["operation"])]
    got = {}
    for r in S.unoverlapped(frame(spark, rows, "q string, start int, end int, type string, text string"), "q").collect():
        got.setdefault(r["q"], []).append((r["start"], r["type"]))
    assert sorted(t for _, t in got["q"]) == ["comparison", "negation"] + ["number"] * 10
    assert sorted(got["p"]) == [(0, "entity"), (5, "object"), (30, "number"), (30, "object")]  # the better one comes later: both stay
    assert sorted(got["r"]) == sorted([(150, "operation")] + [(10 * i, "object") for i in (12, 13, 14)] + [(10 * i, "entity") for i in range(8)])


def test_unoverlapped_goes_through_the_text(spark):
    spans = {
        "a": [(0, 9, "comparison"), (5, 12, "object")], "b": [(0, 9, "object"), (5, 12, "comparison")], "c": [(0, 9, "object"), (5, 12, "object")], "d": [(0, 9, "object"), (5, 14, "object")],
        "e": [(0, 9, "object"), (5, 20, "object")], "f": [(0, 4, "number"), (2, 9, "object")], "g": [(0, 4, "number"), (0, 9, "object")], "h": [(0, 4, "cyber"), (1, 4, "relation")],
    }
    rows = [(q, s, e, t, f"{s}{e}") for q, found in spans.items() for s, e, t in found]
    got = {q: [] for q in spans}
    for r in S.unoverlapped(frame(spark, rows, "q string, start int, end int, type string, text string"), "q").collect():
        got[r["q"]].append(r["start"])
    assert {q: len(found) for q, found in got.items()} == {"a": 1, "b": 2, "c": 1, "d": 1, "e": 2, "f": 1, "g": 2, "h": 1}


QUESTION = "If Ann buys 12 red apples each and sold 5% more than twelve friends, How many are left? Tom's cards cost 3 dollars per day, not 1,250."


def test_families_of_a_question(spark):
    df = frame(spark, [("a", QUESTION), ("b", None), ("c", ""), ("d", "and so"), ("e", "7 boxes")], "q string, question string")
    rows = S.families(df, "q", "question", most=99).collect()
    got = {(r["type"], r["text"]) for r in rows if r["q"] == "a"}
    assert {("rate", "12 red apples each"), ("number", "12"), ("condition", "If"), ("object", "Ann"), ("question_target", "How many are left"), ("number", "twelve"), ("comparison", "more than"), ("rate", "3 dollars per"), ("negation", "not"), ("number", "1,250")} <= got
    assert not any(t == "operation" and x in ("each", "per", "left") for t, x in got)
    assert all(QUESTION[r["start"] : r["end"]] == r["text"] for r in rows if r["q"] == "a")
    assert {r["q"] for r in rows} == {"a", "e"}
    e = sorted((r["span_id"], r["type"], r["text"], r["overlap_group"], r["parent"]) for r in rows if r["q"] == "e")
    assert e == [("span_000", "number", "7", 1, "span_001"), ("span_001", "number_unit", "7 boxes", 1, None)]
    ids = [r["span_id"] for r in sorted((r for r in rows if r["q"] == "a"), key=lambda r: r["span_id"])]
    assert ids == [f"span_{i:03d}" for i in range(len(ids))]
    groups = [r["overlap_group"] for r in sorted((r for r in rows if r["q"] == "a"), key=lambda r: r["span_id"]) if r["overlap_group"]]
    assert groups == sorted(groups) and set(groups) == set(range(1, max(groups) + 1))
    assert len(S.families(df, "q", "question", most=4).where("q = 'a'").collect()) == 4


def test_paired_takes_the_last_row_of_a_role(spark):
    rows = [(1, "t", 1, 9.0), (1, "t", 2, 5.0), (1, "c", 1, 1.0), (2, "t", 1, 3.0), (2, "c", 1, 1.0), (2, "c", 2, None), (3, "t", 1, 1.0), (4, "t", 7, 2.0), (4, "t", 7, 4.0), (4, "c", 0, 1.0)]
    df = frame(spark, rows, "k int, role string, at int, v double")
    assert {r["k"]: r["delta"] for r in J.paired(df, ["k"], "role", "t", "c", "v", order="at").collect()} == {1: 4.0, 4: 3.0}
    assert {r["k"]: r["delta"] for r in J.paired(df, ["k"], "role", "t", "c", "v").collect()} == {1: 8.0, 2: 2.0, 4: 3.0}


def fills_by_definition(template, text, token):
    parts = template.split(token)
    if len(parts) < 2:
        return [], ["missing_mask_token"]
    if not text.startswith(parts[0]):
        return [], ["template_prefix_mismatch"]
    at, fills = len(parts[0]), []
    for hole, part in enumerate(parts[1:]):
        found = text.find(part, at) if part else len(text)
        if found < 0:
            return [], ["template_suffix_mismatch"]
        fills.append((text[at:found], at, found, hole))
        at = found + len(part)
    return fills, ["template_trailing_text_mismatch"] * (at != len(text)) + ["empty_fill_span"] * sum(f[0] == "" for f in fills)


def test_template_fills(spark):
    import random

    rows = [("a [M] b [M]", "a x b yy"), ("a [M]", "b"), ("[M]", ""), ("[M][M]x", "abx"), ("[M] and [M] and end", "1 and 2 and 3 and end"), ("no hole", "no hole"), ("a[M]", "a"), ("é😀[M].", "é😀日本."), ("x [M] y", "x 1 y z"), (None, "a"), ("[M]", None), ("[M] \\E(", "1 \\E(")]
    r = random.Random(0)
    rows += [("".join(r.choice(["a", "b", "[M]", "ab"]) for _ in range(r.randrange(1, 7))), "".join(r.choice("ab") for _ in range(r.randrange(9)))) for _ in range(400)]
    df = frame(spark, [(i, *x) for i, x in enumerate(rows)], "id int, template string, text string")
    got = {x["id"]: x for x in df.select("id", X.template_fills(F.col("template"), F.col("text"), "[M]").alias("f"), X.recovered_fills(F.col("template"), F.col("text"), "[M]").alias("r")).collect()}
    for i, (template, text) in enumerate(rows):
        if template is None or text is None:
            assert got[i]["f"] is None and got[i]["r"] is None
            continue
        fills, warnings = fills_by_definition(template, text, "[M]")
        assert ([tuple(x) for x in got[i]["f"]["fills"]], got[i]["f"]["warnings"], got[i]["f"]["status"]) == (fills, warnings, "warning" if warnings else "ok"), (template, text)
        assert (got[i]["r"]["status"], len(got[i]["r"]["fills"])) == (("failed_fragment_recovery", 0) if warnings else ("ok", len(fills)))
    assert [tuple(x) for x in S.filled_holes(df.where("id = 0"), "id", "template", "text", "[M]").orderBy("hole").collect()] == [(0, 0, 2, 3, "x"), (0, 1, 6, 8, "yy")]


def test_masked_documents_are_aligned(spark, sf):
    from tessera.functions import lexicons as L

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", X.masked(F.col("text"), X.matches(F.col("text"), L.ARABIC_NUMBER)).alias("template"))
    for x in docs.select("*", X.template_fills(F.col("template"), F.col("text")).alias("f")).where("text is not null").collect():
        fills, warnings = fills_by_definition(x["template"], x["text"], "[MASK]")
        assert ([tuple(y) for y in x["f"]["fills"]], x["f"]["warnings"]) == (fills, warnings)


# ---- log


def test_replay_stops_at_a_torn_line(spark):
    lines = ['{"unit_id":"a","status":"pending"}', "", '{"unit_id":"a","status":"running"}', '{"unit_id":"b","status":"odd"}', '{"unit_id":"b","status":"done"}', '{"unit_id":"a","sta', '{"unit_id":"a","status":"done"}']
    log = E.replay(frame(spark, list(enumerate(lines)), "seq long, value string"))
    assert sorted((r["unit_id"], r["status"]) for r in E.current(log).collect()) == [("a", "running"), ("b", "done")]
    units = frame(spark, [("a",), ("b",), ("c",)], "unit_id string")
    assert sorted(r[0] for r in E.pending(units, log).collect()) == ["a", "c"]
    assert [r["unit_id"] for r in E.registered(units, log).collect()] == ["c"]
    assert E.complete(log).collect()[0]["complete"] is False


def test_resumed_work(spark, tmp_path):
    path = str(tmp_path / "out")
    todo = frame(spark, [(i,) for i in range(10)], "id int")
    work = lambda rows: rows.withColumn("sq", F.col("id") * F.col("id"))
    assert E.resumed(todo.where("id < 4"), path, "id", work) == 4
    assert E.resumed(todo, path, "id", work) == 6
    assert E.resumed(todo, path, "id", work) == 0
    assert spark.read.parquet(path).count() == 10


def test_stream_is_written_once(spark, sf, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    for _ in range(2):
        E.written_once(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


# ---- files


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1","n":1}\n\n{"id":"2","n":2}\n')
    assert readers.jsonl_checked(spark, str(p), "id string, n int").count() == 2
    p.write_text('{"id":"1","n":1}\n\n{"id":"2"\n')
    with pytest.raises(readers.SourceError, match="line 3"):
        readers.jsonl_checked(spark, str(p), "id string, n int")
    rows, counts = readers.jsonl_tolerant(spark, str(p), "id string, n int")
    assert rows.count() == 1 and tuple(counts.collect()[0]) == (2, 1)


def test_other_formats(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data":[{"a":1},{"a":2}]}')
    assert [r["a"] for r in readers.json_document(spark, str(tmp_path / "d.json"), "a int", container="data").collect()] == [1, 2]
    (tmp_path / "c.csv").write_text('x,y\n1,"a\nb"\n')
    assert readers.any_records(spark, str(tmp_path / "c.csv")).collect()[0]["y"] == "a\nb"
    with pytest.raises(readers.SourceError):
        readers.any_records(spark, "x.bin")
    (tmp_path / "w.xml").write_text('<C><Weakness ID="079" Name="XSS" Status="Stable"><Description>d  d</Description></Weakness></C>')
    assert tuple(readers.weaknesses(spark, str(tmp_path / "w.xml")).collect()[0]) == ("cwe", "CWE-79", "stable", "XSS", "d d")
    (tmp_path / "s.json").write_text(json.dumps({"objects": [{"type": "attack-pattern", "name": "n", "description": "d", "revoked": True, "external_references": [{"source_name": "x", "external_id": "T1003"}], "kill_chain_phases": [{"phase_name": "b"}, {"phase_name": "a"}, {"phase_name": "b"}]}, {"type": "other"}]}))
    row = readers.techniques(spark, str(tmp_path / "s.json")).collect()[0]
    assert (row["normalized_id"], row["status"], row["tactics"]) == ("T1003", "revoked", ["a", "b"])


def test_zip(spark, tmp_path):
    import zipfile

    doc = {"cveMetadata": {"cveId": "CVE-2020-1", "state": "PUBLISHED"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": " x  y "}], "affected": [{"product": f"p{i % 10}"} for i in range(20)]}}}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/1.json", json.dumps(doc))
        z.writestr("a/readme.txt", "no")
    row = readers.vulnerabilities(readers.zipped_json(spark, str(tmp_path / "z.zip"))).collect()[0]
    assert (row["normalized_id"], row["status"], row["description"], len(row["products"])) == ("CVE-2020-1", "active", "x y", 8)


def test_audit(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question":"q","answer":"a"}\nbroken\n{"question":"q","x":1}\n')
    (tmp_path / "b.jsonl").write_text('{"x":1}\n')
    got = {r["file"][-7:]: r for r in readers.audit(spark, str(tmp_path)).collect()}
    assert (got["a.jsonl"]["records"], got["a.jsonl"]["undecodable"], got["a.jsonl"]["fields"]) == (3, 1, ["answer", "question", "x"])
    assert readers.catalog(readers.audit(spark, str(tmp_path)), (2, 100)).collect()[0]["usable_2"] == 1
    assert readers.files(spark, [str(tmp_path)]).count() == 2
    assert len(readers.fingerprints(spark, str(tmp_path / "b.jsonl")).collect()[0]["sha256"]) == 64


def test_writers(spark, tmp_path):
    df = frame(spark, [(1, float("nan"), [1.0, float("inf")], None)], "a int, b double, c array<double>, d string")
    writers.jsonl(df, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None, "c": [1.0, None], "d": None}
    assert json.loads(writers.json_report(df))["b"] is None
    writers.text_report(df, str(tmp_path / "t"), "hello")
    assert spark.read.text(str(tmp_path / "t")).collect()[0][0] == "hello"
    with pytest.raises(ValueError):
        writers.guarded_output("/etc/x", [str(tmp_path)])


def test_strict_vectors(spark):
    a, v = frame(spark, [(1,), (2,)], "id int"), frame(spark, [(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    assert tensors.strict_vectors(a, v, "id", "v").count() == 2
    with pytest.raises(tensors.TensorError):
        tensors.strict_vectors(a, v.where("id = 1"), "id", "v")
