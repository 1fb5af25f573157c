"""Best-fit packing: the plan against brute force, ids against the library, places by their properties."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, registry

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def least(sizes, capacity):
    """The fewest sequences that hold the sizes, by search."""

    @cache
    def best(rest, gaps):
        if not rest:
            return len(gaps)
        s, out = rest[0], len(gaps) + len(rest)
        for g in set(gaps):
            if g >= s:
                i = gaps.index(g)
                out = min(out, best(rest[1:], tuple(sorted((*gaps[:i], g - s, *gaps[i + 1 :])))))
        return min(out, best(rest[1:], tuple(sorted((*gaps, capacity - s)))))

    return best(tuple(sorted(sizes, reverse=True)), ())


def best_fit(sizes, capacity):
    """Best fit of one size after another, longest first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check_plan(sizes, capacity):
    made = packing.plan(Counter(sizes), capacity)
    held = Counter()
    for n, content in made:
        assert n > 0 and sum(s * c for s, c in content) <= capacity and sum(c for s, c in content if 3 * s > capacity) <= 2
        for s, c in content:
            held[s] += n * c
    assert held == Counter(sizes)
    return sum(n for n, _ in made)


@pytest.mark.parametrize("seed", range(40))
def test_large_pieces_need_as_few_as_can_be(seed):
    r = random.Random(seed)
    capacity = r.choice([9, 20, 31])
    sizes = [r.randrange(capacity // 3 + 1, capacity + 1) for _ in range(9)]
    assert check_plan(sizes, capacity) == least(sizes, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_never_worse_than_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 48, 100])
    sizes = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(r.choice([8, 300]))]
    n = check_plan(sizes, capacity)
    assert -(-sum(sizes) // capacity) <= n <= best_fit(sizes, capacity)
    if len(sizes) == 8:
        assert n <= least(sizes, capacity) + 1


def test_plan_of_counts_of_any_size():
    assert packing.plan({}, 2048) == []
    counts = {s: 10**12 + s for s in range(1, 2049)}
    made = packing.plan(counts, 2048)
    assert len(made) < 20_000
    assert sum(n for n, _ in made) * 2048 - sum(s * n for s, n in counts.items()) < 0.001 * sum(s * n for s, n in counts.items())
    for bad in ({0: 1}, {2049: 1}):
        with pytest.raises(ValueError, match="between"):
            packing.plan(bad, 2048)


TEXTS = ["", " ", "Hello world, it's 12 o'clock", "a<|endoftext|>b", "<|endoftext|>", "naïve  café\n\n\tx", "日本語 текст 한국어", "\U0001f600\U0001f468‍\U0001f469", "x" * 5000, " " * 3000, "^" * 3000, "\x00  ", "ʹ͸\U0001e030\U0001df00\U00010d40 ೦", "don'T 'S's", "1" * 700 + "½²"]


def test_ids_equal_the_library():
    encode, tok = packing.Encoder(*packing.prepared(FILE)), library()
    assert encode.fast is not None
    r = random.Random(0)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), r.randrange(0x10000, 0x20000)])) for _ in range(200)) for _ in range(300)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [" a".join(every[i : i + 50_000]) for i in range(0, len(every), 50_000)]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    other = packing.Encoder(encode.content, "aé")  # as if the two saw these letters differently
    assert [other(t).tolist() for t in TEXTS] == [encode(t).tolist() for t in TEXTS] and other.library is not None


def test_very_long_runs_equal_the_library():
    encode, tok = packing.Encoder(*packing.prepared(FILE)), library()
    for t in ("^" * 1_200_000, " " * 1_200_000 + "a", "ab" * 600_000):
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    content, odd = packing.prepared(path)
    from tokenizers import Tokenizer

    assert odd is None and packing.Encoder(content, odd)("Hello there").tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def checked(rows, docs, capacity):
    """That rows (with ids) are the documents' pieces, in sequences without gap or overlap. Returns the number of sequences."""
    tok, by_doc, places = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in docs)
    if max(Counter(i for i, _ in docs).values()) == 1:
        got = Counter()
        for i, held in by_doc.items():
            held.sort(key=lambda p: p[0])
            assert [p for p, _, _ in held] == list(range(len(held)))
            assert [s for _, s, _ in held] == [sum(len(x) for _, _, x in held[:n]) for n in range(len(held))]
            assert all(len(x) == capacity for _, _, x in held[1:])
            got[i, tuple(x for _, _, ids in held for x in ids)] += 1
        assert got == want
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packed(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "x", "naïve", "<|endoftext|>"]) for _ in range(int(r.expovariate(1 / 40))))) for i in range(400)]
    docs += [(1000 + i, "same length") for i in range(300)] + [(2000, None), (2001, ""), (2002, "word " * 5000), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "length", "offset", "ids", "pid_", "tie", "start")})
    out = packing.packed(df, FILE, capacity=64, with_ids=True)
    rows = out.collect()
    n = checked(rows, docs, 64)
    assert n <= best_fit([x["length"] for x in rows], 64)
    assert sorted(map(tuple, out.drop("ids").collect()), key=repr) == sorted((tuple(x)[:7] for x in rows), key=repr)
    whole = packing.sequences(out).collect()
    assert len(whole) == n and sum(len(x["ids"]) for x in whole) == sum(x["length"] for x in rows)


def test_repeats_and_empty(spark):
    docs = [(1, "a b c")] * 3 + [(1, "d")] + [(2, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.packed(df, FILE, capacity=8, with_ids=True).collect()
    assert len(rows) == 5 and checked(rows, docs, 8) == 3
    assert packing.packed(df.where("doc_id > 5"), FILE).count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = registry.QUERIES["op12_best_fit_packing"](spark, sf).collect()
    tok, want = library(), Counter()
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048
    total = sum(r["length"] for r in rows)
    assert len(places) <= best_fit([r["length"] for r in rows], 2048) and len(places) <= 1.02 * total / 2048 + 1
