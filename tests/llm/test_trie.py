"""The prefix trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, trie

EMPTY = hashlib.sha256(b"").hexdigest()


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, heads=lambda c: zlib.crc32(str(c).encode()) % 9, donor=lambda c: c - int(math.fmod(c, 5))):
    """By definition, with every prefix as a key. Rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, digest(role, text)), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    made = {c: tuple(turns.get(donor(c), [])[: heads(c)] + v[heads(c) :]) for c, v in turns.items()}
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[c] for c in below) or 1
        saved[p] = sum(saved[c] for c in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df, rebuilt=True):
    c = F.col("conv")
    out = trie.conversation_trie(df, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5, 8) if rebuilt else trie.conversation_trie(df)
    rows = [tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, convs=120, turns=12, ids=None):
    r = random.Random(seed)
    rows = []
    for c in ids or range(convs):
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", "", None])) for t in range(r.randrange(turns))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, monkeypatch, seed):
    rows = random_rows(seed, ids=range(-30, 90))
    monkeypatch.setattr(trie, "STRETCH", 3)  # long conversations are cut
    monkeypatch.setattr(trie, "BLOB", 2)
    monkeypatch.setattr(trie, "HOT", [1e-3, 1.0][seed])
    df = frame(spark, rows)
    assert found(df) == brute(rows)
    assert found(df, False) == brute(rows, lambda c: 0, lambda c: c)


def test_turnless_short_donors_and_absent_ones(spark):
    rows = [(1, 0, "u", "x"), (6, 0, "u", "x"), (6, 1, "a", "y"), (5, 0, "u", "x"), (13, 0, "u", "z"), (13, 1, "a", "z"), (14, 0, "u", "q"), (2**62, 0, "u", "x"), (-7, 0, "a", "m")]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[0] == -7 and root[2] is None and root[3] == 7 and root[7] != EMPTY  # conversations without a turn end in the root


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "w" * 300_000
    rows = [(0, None, "u", "first"), (0, 0, "u", long), (0, 1, None, None), (0, 1, "", ""), (0, 2, "u", "b"), (0, 2, "u", "a"), (0, 2, "a", "z"), (10, None, "u", "first"), (10, 5, "u", long), (None, 0, "u", "lost"), (20, 1, "u:", "x"), (30, 1, "u", ":x")]
    df = frame(spark, rows).withColumns({c: F.lit("1") for c in ("conv", "depth", "digest", "size", "s0", "tie", "parent", "length")})
    assert found(df, False) == brute(rows, lambda c: 0, lambda c: c)
    assert found(df) == brute(rows)
    assert found(df.where("conv_id is null")) == found(df.where("turn > 99")) == set()


def test_hot_conversation_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 16)
    monkeypatch.setattr(trie, "BLOB", 50)
    rows = [(0, t, "u", f"t{t % 3}") for t in range(700)]  # a third of all turns
    rows += [(c, t, "u", ["hi", "yes", "no"][t]) for c in range(1, 301) for t in range(3)]  # copies of one conversation
    rows += [(c, t, "u", ["hi", str(c)][t]) for c in range(301, 601) for t in range(2)]  # many children of one turn
    assert found(frame(spark, rows), False) == brute(rows, lambda c: 0, lambda c: c)


def test_comb_takes_a_round_for_each_branching(spark):
    rows = [(c, t, "u", "spine" if t < c else "end") for c in range(1, 13) for t in range(c + 1)]
    assert found(frame(spark, rows), False) == brute(rows, lambda c: 0, lambda c: c)
    bad = spark.createDataFrame([(0, 0, None, -1, 1, 0, 0, 0)], "conv_id long, end long, parent long, up long, left long, leaves long, saved long, weight long")
    with pytest.raises(RuntimeError, match="wait for children"):
        trie.peeled(bad)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in registry.QUERIES["op13_conversation_trie"](spark, sf).collect()}
    assert got == brute(rows)
