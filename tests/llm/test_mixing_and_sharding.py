"""Mixing sources to target weights, and sharding."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def waterfill(sizes, total=None):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [(1, 2, 3)[i % 3] for i in range(len(order))]
    total = sum(n for _, n in order) if total is None else total
    stopped, out = set(), {}
    while True:
        left = total - sum(3 * order[i][1] for i in stopped)
        share = sum(w for i, w in enumerate(weight) if i not in stopped)
        out = {i: 3 * order[i][1] if i in stopped else left * weight[i] / share for i in range(len(order))}
        above = {i for i in out if i not in stopped and out[i] > 3 * order[i][1]}
        if not above:
            return [(s, n, out[i]) for i, (s, n) in enumerate(order)]
        stopped |= above


@pytest.mark.parametrize("seed", range(20))
def test_targets_equal_repeated_sharing(seed):
    rng = random.Random(seed)
    sizes = [(rng.choice([None, "", "é", "Z", "a"]) if i == 0 else f"s{i}", rng.choice([0, 1, 5, 100, 10**6])) for i in range(rng.randint(1, 9))]
    got, want = mixing.targets(sizes), waterfill(sizes)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 * max(1, w[2]) for g, w in zip(got, want, strict=True))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


ROWS = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "c", None, "hot", "hot", "hot"][i % 7], 0) for i in range(900)] + [(5000, None, "a", 0), (5001, "\t x\x0b y ", "tiny", 0), (7, "w", "b", 1), (7, "w", "b", 1), (None, "q r", "b", 0), (6000, "w " * 60000, "long", 0), (6001, None, "void", 0)]


def check_mix(rows, got):
    words = lambda t: len((t or "").split())  # noqa: E731  the rows hold ASCII white space only
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    want = {s: (n, t) for s, n, t in waterfill(list(sizes.items()))}
    by = defaultdict(int)
    assert len(got) == len(rows)
    source = defaultdict(list)
    for i, t, s, _ in rows:
        source[i, words(t)].append(s)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = next(x for x in source[r["doc_id"], r["size"]] if want[x][0] == r["source_size"])
        by[s] += r["taken"]
        assert abs(r["target"] - want[s][1]) < 1e-6 * max(1, r["target"])
    for s, (_, t) in want.items():
        assert by[s] == int(t), s


@pytest.mark.parametrize("ranges", [None, 37])
def test_mix_meets_its_targets(spark, ranges):
    df = table(spark, ROWS).withColumns({"size": F.lit("x"), "taken": F.lit(2), "key": F.lit(3), "l": F.lit(4), "m": F.lit(5)})
    got = mixing.mixed(df, ranges=ranges).collect()
    check_mix(ROWS, got)
    again = mixing.mixed(df.repartition(7), ranges=ranges).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_does_not_depend_on_ranges(spark):
    a, b = (sorted(map(str, mixing.mixed(table(spark, ROWS), ranges=n).collect())) for n in (1, 53))
    assert a == b


def brute_mix(rows):
    """(row, words taken of it) in the order of the keys, one source after another; rows are told apart."""
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    out = []
    for s, n, target in waterfill(list(sizes.items())):
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.sha256(f"0:{'' if r[0] is None else r[0]}".encode()).digest())
        left, epochs = (int(target) % n, int(target) // n) if n else (0, 0)
        for r in mine:
            take = min(left, size(r[1]))
            left -= take
            out.append((r, epochs * size(r[1]) + take))
    return out


def test_mix_equals_brute_force_row_by_row(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 7]
    got = sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(table(spark, rows), ranges=9).collect())
    assert got == sorted((r[0], n) for r, n in brute_mix(rows))


@pytest.mark.parametrize("copies", [1, 2, 40])
def test_realised_equals_brute_force(spark, copies):
    """Ids repeat, a third of the rows have no id, and equal rows stand where a budget ends."""
    rows = [(i, f"t{i} " + " ".join(["w"] * (i % 9)), "abc"[i % 3], 5) for i in range(60)] * copies
    rows += [(None, "same words here", "abc"[i % 2], 5) for i in range(50)] + [(None, None, "a", 0)]
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.realised(table(spark, rows), ranges=5).collect())
    want = Counter()
    for (i, t, s, _), n in brute_mix(rows):
        w = (t or "").split()
        if w:
            want[i, s, t] += n // len(w)
            if n % len(w):
                want[i, s, " ".join(w[: n % len(w)])] += 1
    assert got == want


def test_too_many_sources_are_refused(spark):
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed(table(spark, ROWS), most_sources=3)


def test_mix_of_nothing(spark):
    assert mixing.mixed(table(spark, [])).count() == 0
    got = mixing.mixed(table(spark, [(1, None, None, 0), (2, "", "s", 0)])).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0)] * 2


def test_realised_mix_has_the_words(spark):
    df = table(spark, ROWS).withColumns({"l": F.lit("x"), "size": F.lit(1)})
    mix = mixing.mixed(df).groupBy().agg(F.sum("taken")).collect()[0][0]
    rows = mixing.realised(df)
    assert rows.columns == df.columns
    got = rows.select("doc_id", "text", "n_chars", "source").collect()
    assert sum(len(r["text"].split()) for r in got) == mix
    originals = defaultdict(set)
    for i, t, _, _ in ROWS:
        originals[i].add(t)
    assert all(any((o or "").startswith(r["text"]) for o in originals[r["doc_id"]]) for r in got)


# ---- sharding


def best_capacity(sizes, shards):
    """Smallest largest part over all contiguous cuts."""
    best = None
    for cut in itertools.combinations(range(1, len(sizes)), min(shards, len(sizes)) - 1):
        ends = [0, *cut, len(sizes)]
        worst = max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:], strict=False))
        best = worst if best is None else min(best, worst)
    return best


@pytest.mark.parametrize("seed", range(15))
def test_smallest_capacity_equals_all_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 7]) for _ in range(rng.randint(1, 11))]
    k = rng.randint(1, 4)
    assert sharding.smallest([(i, s) for i, s in enumerate(sizes)], k) == best_capacity(sizes, k)


@pytest.mark.parametrize("seed", range(15))
def test_even_cuts_have_the_largest_smallest_part(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 7]) for _ in range(rng.randint(1, 11))]
    k = rng.randint(1, 4)
    blocks = [(10 * i, s) for i, s in enumerate(sizes)]
    capacity = sharding.smallest(blocks, k)
    starts = [s // 10 for s in sharding.even(blocks, k, capacity)]
    loads = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
    assert sum(loads) == sum(sizes) and max(loads) <= capacity and len(loads) == min(k, len(sizes))
    least = 0
    for cut in itertools.combinations(range(1, len(sizes)), min(k, len(sizes)) - 1):
        ends = [0, *cut, len(sizes)]
        parts = [sum(sizes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        if max(parts) <= capacity:
            least = max(least, min(parts))
    assert min(loads) == least


def test_a_hot_group_leaves_no_shard_empty(spark):
    groups = [(i * 2**50, 10) for i in range(500)] + [(500 * 2**50, 8000)] + [(i * 2**50, 10) for i in range(501, 1001)]
    starts, capacity = sharding.cuts(spark.createDataFrame(groups, "place long, size long"), 8)
    loads = [sum(n for p, n in groups if a <= p < b) for a, b in zip(starts, [*starts[1:], 2**60], strict=True)]
    assert capacity == 8000 and len(loads) == 8 and sorted(loads)[0] >= 1240 and sorted(loads)[-2] <= 2510


@pytest.mark.parametrize("step", [4, 12])
def test_refined_cuts_equal_cuts_over_all_groups(spark, monkeypatch, step):
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    rng = random.Random(step)
    groups = [(rng.randrange(2**60), rng.choice([1, 5, 100, 4000])) for _ in range(300)] + [(2**59, 9000), (2**59 + 1, 20), (2**59 + 2, 30)]
    df = spark.createDataFrame(groups, "place long, size long")
    starts, capacity = sharding.cuts(df, 8)
    assert capacity == sharding.smallest(sorted(groups), 8)
    loads = [sum(n for p, n in groups if a <= p < b) for a, b in zip(starts, [*starts[1:], 2**60], strict=True)]
    assert len(starts) <= 8 and max(loads) == capacity and sum(loads) == sum(n for _, n in groups)


def test_shards(spark):
    rows = [(i, f"text {i % 90} " + "x" * (i % 90)) for i in range(600)] + [(1000 + i, "hot copy") for i in range(300)] + [(2000, None), (2001, ""), (7, "text 1 x"), (None, "n"), (2002, "é" * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "size": F.lit(1), "cell": F.lit(2), "place": F.lit(3)})
    got = sharding.sharded(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots, of_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert all(len(s) == 1 for s in of_text.values())
    group = Counter()
    for _, t in rows:
        group[t or ""] += len((t or "").encode()) + 1
    assert max(load.values()) < max(group.values()) + sum(group.values()) / 8
    assert sharding.sharded(df.where("doc_id > 10000")).count() == 0


def test_shards_are_even_when_groups_are_small(spark, sf):
    got = sharding.sharded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    total = sum(r["n"] for r in got)
    assert len(got) == 8 and max(r["n"] for r in got) < 1.1 * total / 8
