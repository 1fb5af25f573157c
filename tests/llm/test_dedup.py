"""Exact and near deduplication."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup

LONG = "word " * 30000 + "end."


def docs(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


# ---- exact


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_equals_brute_force(spark):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, LONG), (6, LONG), (7, LONG + "!"), (8, "a "), (9, "a"), (9, "a"), (None, "a"), (None, "zz"), (10, "x.\ny"), (11, "x.\ny"), (12, "é" * 5000), (13, "é" * 5000)]
    df = docs(spark, rows, keep_id=1, kept="x", recipe=2, chunks=3, n=4)
    assert sorted(map(tuple, exact_dedup.duplicates(df).collect()), key=str) == exact_brute(rows)
    assert exact_dedup.duplicates(df.where("doc_id > 99")).count() == 0


def test_chunks_rejoin_and_follow_content(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", "", "", ".", "\n"]) for _ in range(3000))
    rows = docs(spark, [(1, text), (2, "new start. " + text)]).select("doc_id", "text", exact_dedup.chunks(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert all("".join(r["c"]) == r["text"] for r in rows)
    assert all(len(c) <= 4096 for r in rows for c in r["c"])
    shared = set(rows[0]["c"]) & set(rows[1]["c"])
    assert len(shared) > len(rows[0]["c"]) // 2


def test_colliding_identifiers_are_void(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1).cast("binary"))
    rows = [(i, f"text {i % 60}") for i in range(200)]
    assert sorted(map(tuple, exact_dedup.duplicates(docs(spark, rows)).collect()), key=str) == exact_brute(rows)


def test_exact_rows_that_stay(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (None, "c")]
    got = exact_dedup.deduplicated(docs(spark, rows, sha="s", mark=1, gone=2))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted([(2, "a"), (4, ""), (5, "b"), (None, "c")], key=str)
    assert got.columns == ["doc_id", "text", "sha", "mark", "gone"]


# ---- near


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def near_brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def family(rng, base, copies, edits):
    words = base.split()
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_equals_brute_force(spark, width, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size, copies, edits in [(120, 40, 6), (60, 30, 3), (200, 30, 14), (20, 20, 2), (8, 10, 1)]:
        texts += family(rng, " ".join(rng.choice(vocabulary) for _ in range(size)), copies, edits)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(60)]
    # a chain: each text near the next, the ends far apart
    chain = [rng.choice(vocabulary) + str(i) for i in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[k * 3 :] + [f"t{j}" for j in range(k * 3)]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, near_dedup.near_duplicates(docs(spark, rows), width=width, percent=percent).collect()))
    assert got == near_brute(rows, width, percent)


def test_near_edges(spark):
    rows = [(5, "A b c"), (3, "a B  c"), (7, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (12, "É x y"), (13, "é x y"), (14, LONG), (15, LONG + " tail"), (20, "a b c"), (20, "a b c")]
    df = docs(spark, rows, component_id=1, n_shingles="x", kept=2, digest=3, rep=4)
    got = sorted(map(tuple, near_dedup.near_duplicates(df, width=3, percent=85).collect()))
    assert got == sorted(near_brute(rows, 3, 85)[:0] + [
        (3, 1, 3, True), (5, 1, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (13, 1, 13, True),
        *[(i, len(shingles(t, 3)), *(lambda r: r)(near_pair(3))[i - 14]) for i, t in ((14, LONG), (15, LONG + " tail"))], (20, 1, 3, False), (20, 1, 3, False),
    ])
    assert near_dedup.near_duplicates(df.where("doc_id > 99"), width=3, percent=85).count() == 0


def near_pair(width):
    a, b = shingles(LONG, width), shingles(LONG + " tail", width)
    near = 100 * len(a & b) >= 85 * len(a | b)
    return [(14, True), (14, False) if near else (15, True)]


def test_null_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "alone here now ok")]
    got = sorted(map(tuple, near_dedup.near_duplicates(docs(spark, rows), width=3, percent=85).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (None, 2, None, True)], key=str)


def test_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for n, d in [(100, 10), (300, 60), (2000, 300), (20000, 4000)]:
        base = rng.integers(0, 2**63, n + d, dtype=np.uint64)
        a, b = np.sort(base[:n]), np.sort(base[d:])
        bits = int(np.bitwise_count(near_dedup.set_sketch(a).view(np.uint64) ^ near_dedup.set_sketch(b).view(np.uint64)).sum())
        assert bits <= 2 * d
        j = (n - d) / (n + d)
        assert not bool(near_dedup._far(np.float64(bits), np.float64(2 * n), int(100 * j), np))
        same = (near_dedup.samples(a) == near_dedup.samples(b)).mean()
        assert abs(same - j) < 0.2
        few = int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.samples(a)).view(np.uint64) ^ near_dedup.odd_sketch(near_dedup.samples(b)).view(np.uint64)).sum())
        assert few <= near_dedup.most_bits(j)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*chain, *star, (300, 200), (200, 250), (7, 7)], "a long, b long")
    got = dict(map(tuple, near_dedup.components(links).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 250: 200, 300: 200}
    assert near_dedup.components(links.where("a < 0")).count() == 0


def test_near_rows_that_stay(spark):
    got = near_dedup.deduplicated(docs(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, "x"), (4, None)], lang="en"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    assert got.columns == ["doc_id", "text", "lang"]
