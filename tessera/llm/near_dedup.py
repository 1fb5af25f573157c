"""MinHash near-deduplication with odd sketches.

1. Each text becomes its set of word shingles (64-bit hashes). From the set come 128 MinHash samples, the
   keys of the LSH bands, and an odd sketch: a bitmap of 512 bits in which every sample flips one bit. The
   population count of the XOR of two sketches estimates how many samples differ, most precisely for high
   similarities. A second odd sketch of 2048 bits has the shingles themselves: its XOR never counts more than
   the sets differ by, so for texts of up to some thousand words it tells pairs just below the threshold from
   pairs above it. Texts with equal sets are one class from here on; only its smallest doc_id goes further.
2. Every band key that two or more classes share names a bucket. Each member is paired with the bucket's
   smallest member, a number of pairs linear in the members. Pairs whose sketches cannot be of similar sets
   fall; the others are confirmed on the full sets.
3. The confirmed links join the members into components. A link that could still be missing joins two
   components that meet in a bucket. Buckets are cut into blocks by hash, and each block says which of its
   components have near sketches: not every pair, but a spanning forest, at most one pair less than it has
   components. These pairs are confirmed, components grow together, and what is left of the large buckets is
   looked at across blocks in the same way. Pairs within a component cannot change the result and are never made.
4. A forest whose pairs are all confirmed leaves nothing out. Where one was refused, the members that have a
   near sketch in another component go, with their full sets, to a task for each pair of blocks, which tests
   them pair by pair and again keeps a forest. Pairs are never rows. What grows with the square of a bucket is how often its
   members are copied: once for each block of others, some n^2 / 1,024 light rows for n members outside the largest component.

The band shape is chosen so that a pair at the threshold shares no bucket with probability under 1e-6, and
the sketch bound lies five standard deviations below the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop_stored, fresh, small_batches, stored

SAMPLES, SKETCH_BITS, SET_BITS = 128, 512, 2048
_WORD = re.compile(WORD)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEED = np.random.default_rng(20240229)
_ODD = (_SEED.integers(0, 2**31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _SEED.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_BITS = _SEED.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than width are one shingle; none without words."""
    words = _WORD.findall(text.translate(_UPPER)) if text and not text.isascii() else _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: for each function the smallest 32-bit image."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    image = np.empty((SAMPLES, min(1024, max(1, len(x)))), np.uint32)
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        out = image[:, : len(part)]
        np.multiply(_ODD[:, None], part[None, :], out=out)
        np.add(out, _ADD[:, None], out=out)
        np.minimum(least, out.min(axis=1), out=least)
    return least


def _parity(at: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits in which each place has the parity of how often it occurs."""
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The odd sketch of (function, sample) pairs."""
    return _parity(_mix(least.astype(np.uint64) ^ _BITS) % np.uint64(SKETCH_BITS), SKETCH_BITS)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of the shingles themselves."""
    return _parity(shingles & np.uint64(SET_BITS - 1), SET_BITS)


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, rows): most rows for which a pair at the threshold is missed with probability under 1e-6."""
    for rows in range(16, 0, -1):
        bands = SAMPLES // rows
        if (1 - threshold**rows) ** bands < 1e-6:
            return bands, rows
    return SAMPLES, 1


def most_bits(threshold: float) -> int:
    """Differing bits above which two sketches are not of sets with similarity of at least the threshold, with five
    standard deviations of the samples' and the folding's error in hand."""
    low = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / SAMPLES))
    flips = 2 * SAMPLES * (1 - low)
    mean = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    return math.ceil(mean + 5 * math.sqrt(SKETCH_BITS / 4 * (1 - math.exp(-4 * flips / SKETCH_BITS)) / 4))


def _far(differing, total, percent: int, lib):
    """Whether two set sketches that differ in so many bits can't be of sets that reach the threshold; total is the sum of
    the sets' sizes. lib is numpy or pyspark.sql.functions. More bits than the sets may differ by are proof; else five
    standard deviations above what that difference makes."""
    most = lib.floor(total * (100 - percent) / (100 + percent))
    share = (1 - lib.exp(most * (-2.0 / SET_BITS))) / 2
    return (differing > most) | (differing > SET_BITS * share + 5 * lib.sqrt(SET_BITS * share * (1 - share)))


def _signatures(width: int, bands: int, rows: int):
    salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            n, digest, keys, sketch, whole = [], [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, width, known)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    keys.append(None)
                    sketch.append(None)
                    whole.append(None)
                    continue
                least = samples(s)
                h = salt.copy()
                for i in range(rows):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + least[i : bands * rows : rows].astype(np.uint64))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(h.view(np.int64))
                sketch.append(odd_sketch(least))
                whole.append(set_sketch(s))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "digest": digest, "bands": keys, "sketch": sketch, "whole": whole})

    return run


def _sets(width: int, held=None):
    """Shingle sets of (doc_id, text, places in the map of ids); of those documents only that the broadcast map `held` may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(_in_map(held.value, [batch.column(f"p{k}").to_numpy() for k in range(3)])))
            if batch.num_rows:
                sets = [shingle_set(t, width, known).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class _Block:
    """Members of a bucket that one task compares: rows of an Arrow table of the columns of DEALT."""

    def __init__(self, rows: pa.Table, bits: int, percent: int):
        self.rows, self.bits, self.percent = rows, bits, percent
        self.side = self.column("side")
        order = np.argsort(self.side, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.rows = rows.take(pa.array(order))
            self.side = self.side[order]
        self.rep, self.comp, self.n = self.column("rep"), self.column("comp"), self.column("n_shingles")
        self.sketch, self.whole = self.words("sketch"), self.words("whole")
        #: Members are compared across the two sides, if there are two, else all with all.
        self.first = int(np.searchsorted(self.side, 1)) if 0 < self.side.sum() < len(self.side) else 0

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    def lists(self, name: str) -> np.ndarray:
        return self.rows.column(name).combine_chunks().flatten().to_numpy().reshape(len(self.rows), -1)

    def words(self, name: str) -> np.ndarray:
        """Sketches as columns: one row for each word, so that comparing one with many runs along memory."""
        return np.ascontiguousarray(self.lists(name).view(np.uint64).T)

    def others(self, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each member and those after it that lie in other components, as root, which may change meanwhile, says."""
        for i in range(self.first or len(root) - 1):
            start = self.first or i + 1
            others = start + np.flatnonzero(root[start:] != root[i])
            if len(others):
                yield i, others

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose sketches may be of sets that reach the threshold, nearest first."""
        n = self.n
        near = others[100 * np.minimum(n[i], n[others]) >= self.percent * np.maximum(n[i], n[others])]
        near = near[_bits_apart(self.sketch, i, near) <= self.bits]
        apart = _bits_apart(self.whole, i, near).astype(np.float64)
        kept = ~_far(apart, (n[near] + n[i]).astype(np.float64), self.percent, np)
        return near[kept][np.argsort(apart[kept], kind="stable")]

    def roots(self) -> np.ndarray:
        return np.unique(self.comp, return_inverse=True)[1]


def _bits_apart(words: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Bits in which one sketch differs from others."""
    out = np.bitwise_count(words[0, others] ^ words[0, one]).astype(np.uint16)
    for w in words[1:]:
        out += np.bitwise_count(w[others] ^ w[one])
    return out


#: A task of a bucket is named by band, kind (0: within x, 1: within others' blocks x and y, 2: others x with the largest component's y), x and y.
TASK = ["band", "kind", "x", "y"]
DEALT = "band long, kind int, x long, y long, side int, rep long, comp long, n_shingles long, sketch array<long>, whole array<long>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, from batches sorted by task. Workers are used again: what Arrow holds on to is given back at the end."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in TASK]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            key = tuple(k[start] for k in keys)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
        held = []
    pa.default_memory_pool().release_unused()


def _forest(bits: int, percent: int):
    """Pairs with near sketches that join the components of a task, as few as do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block = _Block(rows, bits, percent)
            root, found = block.roots(), []
            for i, others in block.others(root):
                near = block.near(i, others)
                for j in near[np.sort(np.unique(root[near], return_index=True)[1])]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
            yield _pairs(block, found)

    return run


def _pairs(block: _Block, found: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(found, np.int64).reshape(-1, 2)
    ends = np.sort(block.rep[at], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ends[:, 0], ends[:, 1], np.full(len(at), block.column("band")[0]))], names=["a", "b", "band"])


def _involved(bits: int, percent: int):
    """Members of a task with a near sketch in another component, that no band before this one has together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block = _Block(rows, bits, percent)
            root, bands = block.roots(), block.lists("bands")
            before = int(np.flatnonzero(bands[0] == block.column("band")[0])[0])
            marked = np.zeros(len(root), bool)
            for i, others in block.others(root):
                near = block.near(i, others)
                near = near[~(bands[near, :before] == bands[i, :before]).any(axis=1)]
                marked[near] = True
                marked[i] |= len(near) > 0
            yield from block.rows.drop_columns(["bands"]).filter(pa.array(marked)).to_batches()

    return run


def _exact(bits: int, percent: int):
    """Links between the members of a task, confirmed on their full sets, as few as join what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block = _Block(rows, bits, percent)
            sets = block.rows.column("shingles").combine_chunks()
            root, found = block.roots(), []
            for i, others in block.others(root):
                mine = sets[i].values.to_numpy()
                for j in block.near(i, others):
                    if root[j] == root[i]:
                        continue
                    common = len(np.intersect1d(mine, sets[int(j)].values.to_numpy(), assume_unique=True))
                    if 100 * common >= percent * (block.n[i] + block.n[j] - common):
                        found.append((i, j))
                        root[root == root[j]] = root[i]
            yield _pairs(block, found)

    return run


def _by_task(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks and in their order. The number of partitions is stated, lest tasks of little data and much work be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TASK).sortWithinPartitions(*TASK)


def _split(labelled: DataFrame) -> DataFrame:
    """band, members, and largest (n, comp), of the buckets in which components meet."""
    parts = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("band").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("largest"))
    return split.where("comps > 1").select("band", "members", "largest")


def _within_blocks(labelled: DataFrame, split: DataFrame, block: int) -> DataFrame:
    """Members of split buckets, each in one task with about `block` others of its bucket."""
    x = F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("members") / block))
    return labelled.join(split, "band").select("band", F.lit(0).alias("kind"), x.alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"), "rep", "comp")


def _across_blocks(labelled: DataFrame, split: DataFrame, block: int) -> DataFrame:
    """Members of split buckets, in tasks that together see every pair of members of different components.

    The largest component needn't meet itself: its blocks meet those of the others, and the others' blocks each other."""
    rest = F.col("members") - F.col("largest.n")
    large, small = F.ceil(F.col("largest.n") / block), F.greatest(F.ceil(rest / block), F.lit(1))
    inside = F.col("comp") == F.col("largest.comp")
    mine = F.pmod(F.xxhash64("rep", "band"), F.when(inside, large).otherwise(small))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"), side.alias("side"))
    with_large = F.when(inside, F.transform(upto(small), lambda k: task(2, k, F.col("mine"), F.lit(1)))).otherwise(F.transform(upto(large), lambda k: task(2, F.col("mine"), k, F.lit(0))))
    others = F.transform(upto(small), lambda k: task(1, F.least(k, F.col("mine")), F.greatest(k, F.col("mine")), (F.col("mine") > k).cast("int")))
    tasks = F.concat(with_large, F.when(inside, F.slice(others, 1, 0)).otherwise(others))
    one = F.array(task(0, F.lit(0), F.lit(0), F.lit(0)))
    dealt = labelled.join(split, "band").withColumn("mine", mine).withColumn("task", F.explode(F.when(F.col("members") <= block, one).otherwise(tasks)))
    return dealt.select("band", "task.*", "rep", "comp")


def ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("id"))


#: Most bits of the map of ids that spares other texts the way to a join: 4 MB.
MAP_BITS = 1 << 25


def _id_map(ids: DataFrame):
    """A Bloom filter of the ids, as a broadcast bitmap, or None. It has at least 16 bits an id while that fits MAP_BITS; with
    fewer than 4 bits an id it would hold nearly all."""
    count = ids.count()
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(16, (16 * count).bit_length()))
    if bits < 4 * count:
        return None
    rows = ids.select(F.explode(F.array(*_places("id"))).alias("at")).select(F.pmod("at", F.lit(bits)).alias("at"))
    got = rows.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toPandas()  # at most MAP_BITS / 32 words, whatever the number of ids
    words = np.zeros(bits // 32, np.uint32)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(words)


def _places(column: str) -> list[Column]:
    return [F.xxhash64(F.col(column), F.lit(k)) for k in range(3)]


def _in_map(words: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(places[0]), bool)
    for at in places:
        at = at.astype(np.int64) & (32 * len(words) - 1)
        ok &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
    return ok


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the distinct ids. A Bloom filter comes ahead of the join, so that rows that it would drop
    needn't be shuffled; for more ids than that can tell apart, rows go to the join as they are."""
    held = _id_map(ids)
    if held is not None:

        @F.pandas_udf("boolean")
        def likely(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(_in_map(held.value, [x.to_numpy(np.int64) for x in (a, b, c)]))

        rows = rows.where(F.col(key).isNotNull()).where(likely(*_places(key)))
    return rows.join(ids.withColumnRenamed("id", key), key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of links (a, b): the smallest id reachable.

    Each round every node points at the neighbour, or itself, that comes first in a random order; links are
    then drawn between what their ends point at. Nodes that nothing points at are gone, so the graph shrinks
    by a constant factor a round whatever its shape, chains and stars included. Rounds are tables in the
    shared folder; nothing but the number of links left reaches the driver.
    """
    edges, steps, turn = links.select("a", "b").where("a <> b"), [], 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(ranked("b", turn)).alias("near"))
        first = near.select(F.col("a").alias("id"), F.least(ranked("a", turn), F.col("near"))["id"].alias("to"))
        step = stored(first, "step")
        steps.append(step)
        moved = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("p")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("q")), "b")
        edges = stored(moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
        turn += 1
        if edges.isEmpty():
            break
    to = steps[0]
    for step in steps[1:]:
        to = to.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    least = to.groupBy("to").agg(F.min("id").alias("least")).select("to", F.least("least", "to").alias("component"))
    return to.join(least, "to").select("id", "component")


def _relabelled(joined: DataFrame, more: DataFrame) -> DataFrame:
    """joined (id, component) with components grown together by links (a, b), which may have ends that joined lacks."""
    name = lambda end, to: joined.select(F.col("id").alias(end), F.col("component").alias(to))
    ends = more.join(name("a", "p"), "a", "left").join(name("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")).distinct()
    grown = stored(components(ends), "grown")
    old = joined.join(grown.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = stored(old.unionByName(grown.join(joined, "id", "left_anti").select("id", "component")), "joined")
    drop_stored(grown)
    drop_stored(joined)
    return out


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of `width`-word shingles of
    the whole text, with A-Z in lower case. A text with fewer words is one shingle; one without words, or
    null, has an empty set and is linked with nothing. Rows that share a doc_id are one document for the
    purpose of reaching others, and each reports its own n_shingles. Rows of null id take the component of
    equal sets, are never its representative, and stay where there is none. An empty table gives no rows.
    Shingles are compared by 64-bit hashes. Only doc_id and text are read. `block` is how many members of a
    bucket a task compares; it doesn't change results.
    """
    threshold = percent / 100
    bands, rows = band_shape(threshold)
    bits = most_bits(threshold)
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    signed = texts.mapInPandas(_signatures(width, bands, rows), "doc_id string, n_shingles long, digest binary, bands array<long>, sketch array<long>, whole array<long>")
    signed = stored(signed.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    named = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(first)
    same = stored(named.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")), "same")
    # by row, so that a set that many documents share is no hot key
    classes = stored(signed.join(same.select("row"), "row", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch", "whole"), "classes")

    banded = classes.select(F.explode("bands").alias("band"), "rep")
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("band", "leader")
    members = stored(banded.join(leaders, "band").select("band", "leader", "rep"), "members")
    stars = stored(members.where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "stars")

    involved = stored(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    sketches = stored(_among(classes, "rep", involved), "sketches")  # of classes that share a bucket
    drop_stored(classes)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    held = _id_map(involved)
    if held is None:
        chosen = chosen.join(involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    with small_batches(docs.sparkSession):
        placed = chosen.select("doc_id", "text", *[p.alias(f"p{k}") for k, p in enumerate(_places("doc_id"))])
        sets = stored(placed.mapInArrow(_sets(width, held), "doc_id long, shingles array<long>"), "sets")

    def confirmed(pairs: DataFrame, among: DataFrame) -> DataFrame:
        both = pairs.join(among.toDF("a", "xa"), "a").join(among.toDF("b", "xb"), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        return stored(both.where(100 * common >= percent * (F.size("xa") + F.size("xb") - common)).select("a", "b").distinct(), "confirmed")

    bit = sketches.select("rep", "sketch", "whole", "n_shingles")
    near = stars.join(bit.toDF("a", "sa", "wa", "na"), "a").join(bit.toDF("b", "sb", "wb", "nb"), "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    far = _far(_differing(F.col("wa"), F.col("wb")).cast("double"), (F.col("na") + F.col("nb")).cast("double"), percent, F)
    links = confirmed(near.where(sizes & (_differing(F.col("sa"), F.col("sb")) <= bits) & ~far).select("a", "b"), sets)
    joined = stored(components(links), "joined")
    rest: list[DataFrame] = [links]

    def labelled() -> DataFrame:
        return members.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))

    def grown(dealt: DataFrame) -> DataFrame:
        """Buckets in which a forest had a pair that wasn't confirmed; components grow by those that were."""
        nonlocal joined
        sketched = _by_task(dealt.join(sketches.select("rep", "n_shingles", "sketch", "whole"), "rep"))
        pairs = stored(sketched.mapInArrow(_forest(bits, percent), "a long, b long, band long"), "forest")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        some = stored(_among(sets, "doc_id", ids), "some")
        more = confirmed(pairs.select("a", "b").distinct(), some)
        open_ = stored(pairs.join(more, ["a", "b"], "left_anti").select("band").distinct(), "open")
        if not more.isEmpty():
            joined = _relabelled(joined, more)
        rest.extend((pairs, some, more, open_))
        return open_

    split = stored(_split(labelled()), "split")
    rest.append(split)
    if not split.isEmpty():
        open_ = grown(_within_blocks(labelled(), split, block)).join(split.where(F.col("members") <= block), "band", "left_semi").select("band")
        large = labelled().join(split.where(F.col("members") > block).select("band"), "band", "left_semi")
        again = stored(_split(large), "split")
        rest.append(again)
        if not again.isEmpty():
            open_ = open_.unionByName(grown(_across_blocks(large, again, 2 * block)))
        left = labelled().join(open_, "band", "left_semi")
        last = stored(_split(left), "split")
        rest.append(last)
        if not last.isEmpty():
            dealt = _across_blocks(left, last, block).join(sketches, "rep").select(*[c.split()[0] for c in DEALT.split(", ")], "bands")
            task = _by_task(dealt).mapInArrow(_involved(bits, percent), DEALT)
            met = stored(task, "met")
            whole = _by_task(met.join(sets.withColumnRenamed("doc_id", "rep"), "rep"))
            with small_batches(docs.sparkSession):
                more = stored(whole.mapInArrow(_exact(bits, percent), "a long, b long, band long"), "exact")
            rest.extend((met, more))
            if not more.isEmpty():
                joined = _relabelled(joined, more.select("a", "b").distinct())

    # a table of its own, so that both sides of the last join come straight from a shuffle and a hot digest can be split
    to = stored(same.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "result")
    for done in (same, members, stars, involved, sketches, sets, joined, *rest):
        drop_stored(done)
    out = signed.join(to, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the smallest doc_id."""
    found = stored(near_duplicates(docs, width=width, percent=percent).where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
