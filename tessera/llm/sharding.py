"""Sharding by minimax contiguous partition.

The atomic groups are the sets of equal texts, in the order of their hash. The smallest capacity for which
a greedy filling needs no more than the given shards is found by binary search. Of the cuts that keep within
that capacity, a second binary search finds those whose smallest shard is as large as can be, and of these the
one that stays nearest to equal shares of what is left is taken: one hot group leaves no shard empty. The
groups are never gathered: the driver sees a list of blocks of neighbouring groups (ranges of the hash with their
total), at first 4096 of them, and asks for a finer division only of the blocks at which the filling stops for
the largest capacity that fails. When all of those are single groups, no finer division can change the capacity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Bits of the group order, and how many of them one division looks at.
ORDER_BITS, STEP_BITS = 60, 12


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and place (60 bits of the text's sha256) for each row."""
    text = F.coalesce("text", F.lit(""))
    place = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, ORDER_BITS // 4), 16, 10).cast("long")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"))


def fill(blocks: list[tuple[int, int]], capacity: int) -> list[int]:
    """Starts of the runs when each run takes blocks (start, size) in order while they fit."""
    starts, used = [], None
    for start, size in blocks:
        if used is None or used + size > capacity:
            starts.append(start)
            used = 0
        used += size
    return starts


def smallest(blocks: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity with which fill needs at most `shards` runs."""
    low, high = max((s for _, s in blocks), default=0), sum(s for _, s in blocks)
    while low < high:
        middle = (low + high) // 2
        if len(fill(blocks, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def even(blocks: list[tuple[int, int]], shards: int, capacity: int) -> list[int]:
    """Starts of at most `shards` runs of the blocks, none above the capacity (which `fill` can meet), the smallest as large as any
    such cut has it, and each as near to an equal share of what is left as that allows. With no more blocks than shards each is a run."""
    if len(blocks) <= shards:
        return [start for start, _ in blocks]
    sums = np.concatenate(([0], np.cumsum([size for _, size in blocks], dtype=np.int64)))

    def ways(least: int) -> list[np.ndarray]:
        """For each number of runs whether they can make up what follows each place."""
        out = [np.arange(len(sums)) == len(sums) - 1]
        first = np.searchsorted(sums, sums + least, side="left")
        past = np.searchsorted(sums, sums + capacity, side="right")
        for _ in range(shards):
            count = np.concatenate(([0], np.cumsum(out[-1])))
            out.append((past > first) & (count[past] > count[np.minimum(first, len(sums))]))
        return out

    low, high = 1, int(sums[-1]) // shards
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if ways(middle)[shards][0] else (low, middle - 1)
    rest, at, starts = ways(low), 0, []
    for left in range(shards, 0, -1):
        starts.append(blocks[at][0])
        load = sums - sums[at]
        ends = np.flatnonzero(rest[left - 1] & (load >= low) & (load <= capacity))
        at = int(ends[np.abs(load[ends] * left - (sums[-1] - sums[at])).argmin()])
    return starts


def cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First place of each shard, and the capacity, for groups (place, size)."""

    def divided(ranges: list[tuple[int, int]] | None, bits: int) -> list[tuple[int, int, int, int]]:
        """(start, bits left, size, groups) of the parts of the given (start, bits) ranges."""
        left = bits - STEP_BITS
        rows = groups
        if ranges is not None:
            rows = rows.where(F.shiftright("place", bits).isin([s >> bits for s, _ in ranges]))
        cell = F.shiftright("place", left)
        return [(r["cell"] << left, left, r["size"], r["n"]) for r in rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()]

    blocks = sorted(divided(None, ORDER_BITS))
    while True:
        plain = [(b[0], b[2]) for b in blocks]
        best = smallest(plain, shards)
        # a block larger than the capacity that fails, and those at which the filling stops, may hide a finer cut
        known = {b[0]: b for b in blocks}
        stops = [known[s] for s in fill(plain, best - 1)[1:]] + [b for b in blocks if b[2] >= best]
        if len(blocks) < shards:
            stops = blocks
        coarse = {b[0]: b for b in stops if b[3] > 1 and b[1] > 0}
        if not coarse:
            return even(plain, shards, best), best
        for bits in {b[1] for b in coarse.values()}:
            some = [(b[0], bits) for b in coarse.values() if b[1] == bits]
            fine = divided(some, bits)
            for start, _ in some:
                known.pop(start)
            known.update({f[0]: f for f in fine})
        blocks = sorted(known.values())


def sharded(docs: DataFrame, shards: int = 8, slot_cells: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row.

    The law is `bytes`: the largest shard, by UTF-8 bytes of the texts plus one a row, is as small as any
    cut of the group order allows, and the others are as even as that leaves room for. Equal texts lie in one shard; null and empty texts are one
    group. slot counts the rows of a shard from 0 without gaps. With fewer groups than shards the last
    shards stay empty; an empty table gives no rows. Rows of null or repeated doc_id are placed like others.

    Slots are dealt from slot_cells hashed cells of each shard, so a hot group is spread over them all: 512, or as many as make
    50,000 rows a cell. The cells' counts are joined, one row for 50,000. Texts of any length count whole.
    """
    rows = stored(sizes(docs), "sizes")
    groups = stored(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    starts, _ = cuts(groups, shards)
    drop_stored(groups)
    if slot_cells is None:
        slot_cells = max(512, -(-rows.count() // (50_000 * shards)))
    shard = F.lit(-1)
    for s in starts:
        shard = shard + (F.col("place") >= s).cast("int")
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slot_cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "place")).cast("long") - 1 + F.col("before")
    return rows.join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
