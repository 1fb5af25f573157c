"""Terms counted by number, and what rungs of the same text share."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import ml, sparse, terms

TEXTS = [["red", "blue", "red", "blue", "red"], [], ["blue", None, "red", "äöü"], ["x"], None, ["red", "blue"]]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_definition(unit):
    out = []
    for words in TEXTS:
        words = words or []
        if unit == "word":
            found = [w for w in words if w] + [f"{a} {b}" for a, b in itertools.pairwise(words) if a and b]
        else:
            found = [f" {w} "[i : i + n] for w in words if w for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        out.append(Counter(found))
    return out


@pytest.mark.parametrize("unit", ["word", "char"])
def test_terms_of_a_batch_are_counted(unit):
    got = [Counter() for _ in TEXTS]
    for names, row, term, tf in terms.counted(pa.array(TEXTS, pa.list_(pa.string())), unit):
        assert len(set(zip(row.tolist(), term.tolist(), strict=True))) == len(row) and np.all(np.diff(term) >= 0)
        for r, t, n in zip(row.tolist(), term.tolist(), tf.tolist(), strict=True):
            got[r][names[t].as_py()] += n
    assert got == by_definition(unit)


@pytest.mark.parametrize("unit", ["word", "char"])
def test_no_words_have_no_terms(unit):
    for lists in (pa.array([], pa.list_(pa.string())), pa.array([[], []], pa.list_(pa.string()))):
        assert all(len(row) == len(tf) == 0 for _, row, _, tf in terms.counted(lists, unit))


def test_batches_are_cut_between_rows(monkeypatch):
    monkeypatch.setitem(terms.BATCH, "word", 4)
    batch = pa.record_batch({"t": pa.array([["a"], ["b", "c"], ["d"] * 9, [], None, ["e"] * 4, ["f"]], pa.list_(pa.string()))})
    parts = [p.column("t").to_pylist() for p in terms.slices(batch, "t", "word")]
    assert list(itertools.chain(*parts)) == batch.column("t").to_pylist() and [len(p) for p in parts] == [2, 1, 3, 1]


def test_rungs_of_one_text_share_its_rows(spark, monkeypatch):
    made, passes = [], []
    designs, passed = sparse.designs, sparse._passed
    monkeypatch.setattr(sparse, "designs", lambda df, rung, **o: made.append(rung.text) or designs(df, rung, **o))
    monkeypatch.setattr(sparse, "_passed", lambda *a: passes.append(len(a[2])) or passed(*a))
    df = spark.createDataFrame([(i, i, int(i % 2), "red blue" if i % 3 else "blue green", float(i % 5), float(i % 7), i % 2) for i in range(16)], "id long, grp int, y int, text string, a double, b double, fold int")
    rungs = {"O": sparse.Rung("text", {"f": ["a"]}), "H": sparse.Rung(None, {"f": ["b"]}), "O_H": sparse.Rung("text", {"f": ["a"], "h": ["b"]})}
    scores, report = sparse.ladder(df, rungs, id="id", label="y", group="grp", fold="fold", k=2, inner_k=0, tolerance=1e-2)
    assert made == ["text", None] and set(passes) == {4, 2}
    features = {(r["rung"], r["fold"]): (r["features"], r["blocks"]) for r in report.collect()}
    assert {b.split(", ")[-1] for (n, _), (_, b) in features.items() if n == "O_H"} == {"h 1"} and features["H", 0] == (1, "f 1")
    assert all(features["O", f][0] + 1 == features["O_H", f][0] for f in range(2))
    # each alone has the same values
    for name, rung in rungs.items():
        alone = {r["id"]: r[f"oof_{name}"] for r in sparse.ladder(df, {name: rung}, id="id", label="y", group="grp", fold="fold", k=2, inner_k=0, tolerance=1e-2)[0].collect()}
        assert {r["id"]: r[f"oof_{name}"] for r in scores.collect()} == pytest.approx(alone, abs=1e-6)


@pytest.mark.parametrize("unit", ["word", "char"])
def test_tfidf_counts_within_tasks(spark, unit):
    data = [(1, "red blue red", 1), (1, "green red", 1), (2, "Blue green", 1), (None, "red green", 1), (3, "blue green", 0), (3, "red", 1), (4, None, 1), (5, "", 0), (6, "only once", 1)]
    df = spark.createDataFrame(data, "k int, t string, train int")
    made = ml.tfidf(df, "k", "t", train=F.col("train") == 1, unit=unit, sizes=(3, 4))
    # terms are neither a row each before they are weighed, nor sorted by key for their length
    assert "Generate" not in plan(made) and "Window" not in plan(made) and plan(made).count("Exchange") == 1

    def cut(text):
        words = (text or "").lower().split()
        if unit == "word":
            return words + [f"{a} {b}" for a, b in itertools.pairwise(words)]
        return [f" {w} "[i : i + n] for w in words for n in (3, 4) for i in range(len(w) + 3 - n)]

    tf = {}
    for k, text, train in data:
        tf.setdefault((k, train), Counter()).update(cut(text))
    seen = Counter(t for (_, train), c in tf.items() if train for t in c)
    n = sum(train for *_, train in data)
    raw = [(k, t, (1 + math.log(m)) * (math.log((1 + n) / (1 + seen[t])) + 1)) for (k, _), c in tf.items() for t, m in c.items() if seen[t] >= 2]
    want = sorted((str(k), t, w / math.sqrt(sum(x * x for o, _, x in raw if o == k))) for k, t, w in raw)
    got = sorted((str(r["k"]), r["term"], r["weight"]) for r in made.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert ml.tfidf(df.where("k > 9"), "k", "t", unit=unit).collect() == []


@pytest.mark.parametrize("packed", [False, True])
def test_rows_are_worked_on_in_steps(monkeypatch, packed):
    monkeypatch.setattr(sparse, "STEP", 5)
    lists = [[0, 2], [], [1, 2, 3], [0, 1, 2, 3, 4, 5, 6], [], [6]]
    start, at = np.cumsum([0, *map(len, lists)]).astype(np.int32), np.array([i for x in lists for i in x], np.int32)
    cells = {n: sparse._cells(start, x, packed) for n, x in (("indices", at), ("vals", at + 0.5))}
    batch = pa.record_batch({"design": pa.array([1, 1, 0, 1, 0, 1], pa.int32()), "id": pa.array(range(6)), "y": pa.array([0.0] * 6), "fold": pa.array([0] * 6), "inner": pa.array([0] * 6), **cells})
    weights = np.append(np.arange(7) * 1.0, 10.0)
    steps = list(sparse._rows(batch))
    assert {i: v for _, x in steps for i, v in zip(x.id.tolist(), x.times(weights), strict=True)} == {i: 10 + sum(j * (j + 0.5) for j in own) for i, own in enumerate(lists)}
    assert [(d, x.id.tolist()) for d, x in steps] == [(0, [2, 4]), (1, [0, 1]), (1, [3]), (1, [5])]
    back = sum(x.back(np.ones(len(x.sizes)), 7) for _, x in steps)
    assert back.tolist() == [*np.bincount(at, at + 0.5, 7), 6.0]


def test_runs_of_characters_are_those_of_strings():
    lists = [["é漢", "a", "\0b\0", "😀x😀yz"], None, ["a", "é漢", "a"], [None, "abcdefgh"]]
    many = [["".join(chr(0x4E00 + (i * j) % 7001) for j in range(1, 7)) for i in range(1500)]]
    for rows in (lists, many):  # more letters than a number of 63 bits has room for are counted as strings
        for sizes in ((3, 5), (4, 6), (1, 2)):
            got = [Counter() for _ in rows]
            for names, row, term, tf in terms.counted(pa.array(rows, pa.list_(pa.string())), "char", sizes):
                names.validate(full=True)
                for r, t, n in zip(row.tolist(), names.take(pa.array(term)).to_pylist(), tf.tolist(), strict=True):
                    assert t not in got[r]
                    got[r][t] = n
            assert got == [Counter(x for w in own or [] if w for x in terms._runs(w, *sizes)) for own in rows]


def test_numbers_are_ordered_in_one():
    a, b = np.array([3, 0, 3, 1]), np.array([9, 5, 2, 0])
    assert terms.ordered((a, 4), (b, 10)).tolist() == [(0 << 4) + 5, 1 << 4, (3 << 4) + 2, (3 << 4) + 9]
    assert terms.ordered((a, 1 << 40), (b, 1 << 24)) is None
    for big in (1, 1 << 60):  # as one number, and where that has no room
        assert [x.tolist() for x in sparse._sorted(a * big, b)] == [[0, big, 3 * big, 3 * big], [5, 0, 2, 9]]


def test_terms_are_summed_in_buckets():
    names = [["red", "", "äöü", "blue red", "x" * 300, "red blue"], ["äöü", "red", "green"], ["pad", "", "red", "x" * 300]]
    dealt = [terms.in_buckets(pa.array(n, pa.string()).slice(j == 2), [np.arange(len(n))[j == 2 :] + 1, np.full(len(n) - (j == 2), 10 * j)], 4) for j, n in enumerate(names)]
    seen = {}
    for batch in dealt:
        assert batch.num_rows <= 4  # one row for a bucket's terms, whatever their number
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            seen.setdefault(b, []).append(data)
    got = [(b, t, x, y) for b, data in seen.items() for t, x, y in zip(*terms.merged(pa.chunked_array([pa.array([d.as_py() for d in data], pa.binary())])).to_pydict().values(), strict=True)]
    assert sorted(r[1:] for r in got) == sorted([("red", 6, 30), ("", 4, 20), ("äöü", 4, 10), ("blue red", 4, 0), ("x" * 300, 9, 20), ("red blue", 6, 0), ("green", 3, 10)])
    assert len({b for b, *_ in got}) > 1


def test_vocabularies_send_buckets(spark):
    df = spark.createDataFrame([(i, [f"t{j}" for j in range(i, 40, 3)] * (1 + i % 2), i % 3) for i in range(12)], "id long, t array<string>, f int")
    got = sparse.vocabularies(df, F.col("t"), "f", 3, most_terms=7, buckets=5)
    rows = df.collect()
    for f in range(3):
        train = [r["t"] for r in rows if r["f"] != f]
        tf, seen = Counter(t for own in train for t in own), Counter(t for own in train for t in set(own))
        best = sorted(sorted((t for t in tf if seen[t] >= 2), key=lambda t: (-tf[t], t))[:7])
        assert {t: (i, pytest.approx(math.log((1 + len(train)) / (1 + seen[t])) + 1)) for i, t in enumerate(best)} == got[f]
    assert sparse.vocabularies(df.where("id > 99"), F.col("t"), "f", 3) == [{}] * 3


@pytest.mark.parametrize("text", ["text", None])
def test_rows_are_stored_once_for_all_designs(spark, monkeypatch, text):
    monkeypatch.setattr(sparse, "SHARED_STEP", 40)
    data = [(i, int(i % 5 < 2), i % 3, [-1 if d == i % 3 else (i // 3 + d) % 2 for d in range(3)], ["red blue red", "", "blue green", None, "red red red green é"][i % 5], float(i % 7), 1e6 + i % 4) for i in range(30)]
    df = spark.createDataFrame(data, "id long, y int, fold int, inner array<int>, text string, a double, b double")
    how = {"id": "id", "label": "y", "fold": "fold", "inner": "inner", "k": 3}
    rung = sparse.Rung(text, {"f": ["a"], "h": ["b"]})
    plain, widths = sparse.designs(df, rung, **how)
    shared, same = sparse.designs(df, rung, **how, packed=True)
    assert same == widths and shared.inner == [True] * 3
    assert plain.count() == 90 and shared.rows.count() == 30
    totals = [sum(w.values()) for w in widths]
    fits = [sparse.SparseFit(d, g, 1.0) for d in range(3) for g in (None, 0, 1)]
    rng = np.random.default_rng(0)
    points = [rng.normal(size=totals[f.design] + 1) for f in fits[:-1]] + [None]
    for a, b in zip(sparse._passed(plain, totals, fits, points), sparse._passed(shared, totals, fits, points), strict=True):
        assert (a is None) == (b is None)
        if a is not None:
            assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1], atol=1e-9)
    points[-1] = points[-2]
    one, two = ({(r["model"], r["id"]): (r["y"], r["value"]) for r in sparse.scored(rows, totals, fits, points).collect()} for rows in (plain, shared))
    assert one.keys() == two.keys() and all(two[i] == pytest.approx(v) for i, v in one.items())


def test_models_work_on_no_rows_but_their_own(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, i % 3, [(i // 3) % 2] * 3, "red blue", 1.0) for i in range(24)], "id long, y int, fold int, inner array<int>, text string, a double")
    shared, _ = sparse.designs(df, sparse.Rung("text", {"f": ["a"]}), id="id", label="y", fold="fold", inner="inner", k=3, packed=True)
    fits = [sparse.SparseFit(d, g, c) for d in range(3) for c in (0.1, 1.0) for g in range(2)]
    taken = Counter()
    for batch in shared.rows.toArrow().to_batches():
        for x in sparse._counts(batch, shared.parts, shared.width, 3, 1):
            for d in range(3):
                own = [f for f in fits if f.design == d]
                for rows, models in x.used(d, own):
                    assert all(x.fold[r] != d and x.inner[r, d] != own[m].without for r in rows for m in models)
                    taken.update({(d, m): len(rows) for m in models})
    # 8 of a design's 24 rows are its fold, and half of the others are left out by each inner model
    assert taken == {(d, m): 8 for d in range(3) for m in range(4)}


def test_a_pass_has_few_tasks(spark):
    assert sparse._few(spark.range(64).repartition(64)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
