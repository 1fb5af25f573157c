"""Hard-negative mining: norm-bucketed search in a window of scores for each anchor and positive.

Candidates are sorted by length and cut into buckets of similar length. An anchor q is searched twice. First for its
positives: the rows of its own label with the highest inner products. Each positive's score p then gives a window of
scores, and the second search keeps the highest scores of other labels inside each window. In both a bucket whose
longest vector has length L can be passed over as soon as |q| L is below what still counts (Cauchy-Schwarz): the lower
limit of the window or, once a window is full, its k-th best score so far, whichever is higher.

The work is a grid: groups of anchors by lanes of buckets. A cell is one stream of rows: the anchors' group first, then
the buckets of the lane, longest first, so that limits rise early; it holds one group, one bucket and k scores a window.
A group has at most `group_rows` anchors, so memory is bounded whatever the table holds. Every bucket goes to each group
once, unless the group's least limit already rules it out, and every group to each lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored
from .topk import LIMIT, _bytes, _matrix, quantised

#: Lower than any score.
NONE = -(2**63)

PACKED = "block long, longest double, n int, dim int, ids binary, labels binary, matrix binary"
FOUND = "block long, at int, vec_id long, score long"
#: A lane has so many rows at least, since each returns up to k rows a window.
LANE_ROWS = 8192
#: Rows of several hundred kilobytes that go to Python at a time.
BATCH = 16


def _pack(rows: int):
    """Consecutive rows (vec_id, label, v, part) as blocks of at most so many rows of one part. The block's number is unique."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, serial, kept, part = TaskContext.get().partitionId(), 0, [], None

        def block(held):
            nonlocal serial
            dim = max(len(v) for _, _, v in held)
            matrix = np.zeros((len(held), dim), np.int64)
            for i, (_, _, v) in enumerate(held):
                matrix[i, : len(v)] = v
            longest = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
            serial += 1
            ids, labels = (np.array([r[i] for r in held], np.int64).tobytes() for i in (0, 1))
            return pd.DataFrame({"block": [(task << 32) + serial], "longest": [longest], "n": [len(held)], "dim": [dim], "ids": [ids], "labels": [labels], "matrix": [_bytes(matrix)]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if kept and (len(kept) >= rows or r.part != part):
                    yield block(kept)
                    kept = []
                part = r.part
                kept.append((r.vec_id, r.label, r.v))
        if kept:
            yield block(kept)

    return pack


class Group:
    """Anchors of a cell: vectors in the order of their labels, a window of scores per slot, and the k best found in each."""

    def __init__(self, ids: bytes, labels: bytes, matrix: bytes, n: int, dim: int, limits: list, slots: int, k: int):
        labels = np.frombuffer(labels, np.int64)
        order = np.argsort(labels, kind="stable")
        self.place, self.labels, self.ids = order, labels[order], np.frombuffer(ids, np.int64)[order]
        self.matrix, self.k = _matrix(matrix, n, dim, dim)[order], k
        self.length = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(axis=1))
        self.low, self.high = np.full((slots, n), NONE if limits is None else LIMIT), np.full((slots, n), LIMIT if limits is None else NONE)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        for at, slot, low, high in limits or ():
            self.low[slot, back[at]], self.high[slot, back[at]] = low, high
        self.best_id, self.best = np.full((slots, n, k), LIMIT), np.full((slots, n, k), NONE)
        self.full = np.zeros((slots, n), np.int64)  # how many of the k places are taken

    def least(self) -> np.ndarray:
        """Of each anchor, the least score that may still count in any window; LIMIT if it has no window."""
        risen = np.where(self.full >= self.k, np.maximum(self.low, self.best[:, :, -1]), self.low)
        return np.where(self.low > self.high, LIMIT, risen).min(axis=0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T in 64 bits, exact; products that 64 bits don't hold stand at the ends of the type."""
    most = float(max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))), 1)) * float(max(abs(int(b.min(initial=0))), abs(int(b.max(initial=0))), 1)) * max(a.shape[1], 1)
    if most < 2.0**53:  # doubles are exact
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LIMIT, LIMIT).astype(np.int64)


def _keep(g: Group, slot: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
    """Merge the scores of a bucket (anchors `rows` by vectors `ids`) into the k best of a slot."""
    floor = np.where(g.full[slot, rows] >= g.k, np.maximum(g.low[slot, rows], g.best[slot, rows, -1]), g.low[slot, rows])
    inside = allowed & (scores >= floor[:, None]) & (scores <= g.high[slot, rows][:, None])
    many = np.flatnonzero(inside.sum(axis=1) > g.k)
    if len(many):  # what is below the bucket's own k-th best can't stay
        held = np.where(inside[many], scores[many], NONE)
        kth = np.partition(held, held.shape[1] - g.k, axis=1)[:, held.shape[1] - g.k]
        inside[many] &= scores[many] >= kth[:, None]
    i, j = np.nonzero(inside)
    if not len(i):
        return
    touched, where = np.unique(i, return_inverse=True)
    old = rows[touched]
    taken = g.full[slot, old]
    o_i, o_j = np.nonzero(np.arange(g.k)[None, :] < taken[:, None])
    owner = np.concatenate([where, o_i])
    value, name = np.concatenate([scores[i, j], g.best[slot, old][o_i, o_j]]), np.concatenate([ids[j], g.best_id[slot, old][o_i, o_j]])
    order = np.lexsort((name, -value, owner))
    owner, value, name = owner[order], value[order], name[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    stay = rank < g.k
    owner, value, name, rank = owner[stay], value[stay], name[stay], rank[stay]
    g.best[slot, old], g.best_id[slot, old] = NONE, LIMIT
    g.best[slot, old[owner], rank], g.best_id[slot, old[owner], rank] = value, name
    g.full[slot, old] = np.bincount(owner, minlength=len(old))


def _meet(g: Group, ids: bytes, labels: bytes, matrix: bytes, n: int, dim: int, longest: float, same: bool, slice_rows: int = 1024) -> int:
    """One bucket against the group: rows of the anchor's label, or of all others. Returns the anchors it wasn't passed over for."""
    least = g.least().astype(np.float64)
    asked = np.flatnonzero((least <= 0) | (g.length * longest * (1 + 1e-9) >= least))
    if not len(asked):
        return 0
    width = max(dim, g.matrix.shape[1])
    if g.matrix.shape[1] < width:
        g.matrix = np.pad(g.matrix, ((0, 0), (0, width - g.matrix.shape[1])))
    labels, ids, rows = np.frombuffer(labels, np.int64), np.frombuffer(ids, np.int64), _matrix(matrix, n, dim, width)
    order = np.argsort(labels, kind="stable")
    labels, ids, rows = labels[order], ids[order], rows[order]
    if same:  # one product for each label of both sides
        parts = [(asked[np.searchsorted(g.labels[asked], x) : np.searchsorted(g.labels[asked], x, "right")], slice(np.searchsorted(labels, x), np.searchsorted(labels, x, "right"))) for x in np.intersect1d(g.labels[asked], labels)]
    else:
        parts = [(asked, slice(0, n))]
    for whole, cut in parts:
        for start in range(0, len(whole), slice_rows):
            at = whole[start : start + slice_rows]
            scores = _products(g.matrix[at], rows[cut])
            allowed = ids[cut][None, :] != g.ids[at][:, None]
            if not same:
                allowed &= labels[None, :] != g.labels[at][:, None]
            for slot in range(len(g.low)):
                _keep(g, slot, at, scores, ids[cut], allowed)
    return len(asked)


def _search(slots: int, k: int, same: bool):
    def found(block: int, g: Group) -> pd.DataFrame:
        s, i, r = np.nonzero(np.arange(k)[None, None, :] < g.full[:, :, None])
        out = pd.DataFrame({"block": np.full(len(s), block), "at": g.place[i].astype(np.int32), "vec_id": g.best_id[s, i, r], "score": g.best[s, i, r], "r": r, "s": s})
        # a row that stands in several windows goes once; rows said several times keep their number
        out["copy"] = out.groupby(["s", "at", "vec_id", "score"]).cumcount()
        return out.drop_duplicates(["at", "vec_id", "score", "copy"])[["block", "at", "vec_id", "score"]]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, block, cell = None, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.kind == 0:
                    if group is not None:
                        yield found(block, group)
                    limits = None if r.limits is None else [(x["at"], x["slot"], x["low"], x["high"]) for x in r.limits]
                    group, block, cell = Group(r.ids, r.labels, r.matrix, r.n, r.dim, limits, slots, k), r.block, (r.lane, r.owner)
                elif group is not None and cell == (r.lane, r.owner):
                    _meet(group, r.ids, r.labels, r.matrix, r.n, r.dim, r.longest, same)
        if group is not None:
            yield found(block, group)

    return search


def _cells(groups: DataFrame, buckets: DataFrame, lanes: int) -> DataFrame:
    """The streams of all cells: rows of kind 0 (a group, with its limits) and 1 (buckets), in order."""
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    # what the least demanding anchor of a group needs: shorter buckets don't even travel
    needs = groups.select(F.col("block").alias("owner"), "reach")
    columns = ["lane", "owner", "kind", "block", "longest", "n", "dim", "ids", "labels", "matrix", "limits"]
    limits = groups.schema["limits"].dataType
    left = groups.withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "owner": F.col("block"), "kind": F.lit(0)}).select(*columns)
    owners = F.broadcast(needs.agg(F.collect_list(F.struct("owner", "reach")).alias("owners")))  # 16 bytes for each group_rows anchors
    right = buckets.join(owners).select("*", F.explode("owners").alias("o")).where(F.col("longest") * (1 + 1e-9) >= F.col("o.reach"))
    right = right.withColumns({"lane": lane, "owner": F.col("o.owner"), "kind": F.lit(1), "limits": F.lit(None).cast(limits)}).select(*columns)
    # the lanes of a group go to partitions beside each other, so that none gets two while another has none
    n = max(lanes, min(lanes * groups.count(), int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = left.unionByName(right).repartitionById(n, F.pmod(F.xxhash64("owner") + F.col("lane"), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("lane", "owner", "kind", F.desc("longest"), "block")


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bucket_rows: int = 1024, group_rows: int = 16_384, lanes: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the `positives` highest-scored other rows of its label, all if fewer. For each of them, its
    negatives are the first k (all if fewer; none gives no row) of the rows of other labels whose score is between low and
    high percent of the positive's. Scores are exact integer products of floor(scale * x); higher ones come first, ties go by
    smaller id. A positive of negative score has no negatives (its window is empty), one of score 0 those of score 0.

    `anchors` is a condition on the columns `vec_id` (the id) and `label`. Rows take no part whose id, label or vector is null, or whose
    vector holds a null or non-finite component. Labels are whole numbers. Rows that share an id are never each other's
    positives or negatives, but each counts by itself: repeated anchors give their rows each, repeated candidates take a
    rank each. Vectors of different lengths are padded with zeros. Components and products beyond 64 bits are held at the ends of the type, so
    they tie. Empty tables, tables without anchors and tables of one label give no rows. Other columns are not read.

    Nothing but the numbers of rows, anchors and groups comes to the driver. Groups are broadcast as their number and reach alone, 16 bytes for group_rows anchors.
    Lanes (by default so many that groups times lanes make the shuffle partitions, with LANE_ROWS rows each at least) change cost, not results.
    """
    spark = vectors.sparkSession
    sound = F.forall(F.col("raw"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = rows.where("vec_id is not null and label is not null and raw is not null").where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", quantised(F.col("raw"), scale).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    in_order = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = stored(in_order.select("vec_id", "label", "v", F.lit(0).alias("part")).mapInPandas(_pack(bucket_rows), PACKED), "negative-buckets")
    asked = rows.where(anchors)
    n_groups = max(1, -(-asked.count() // group_rows))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")
    dealt = asked.select("vec_id", "label", "v", part.alias("part")).repartition(n_groups, "part").sortWithinPartitions("part", "vec_id")
    groups = stored(dealt.mapInPandas(_pack(group_rows + group_rows // 4), PACKED), "negative-anchors")
    if lanes is None:
        held = buckets.agg(F.sum("n")).collect()[0][0] or 0
        lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) // n_groups, -(-held // LANE_ROWS)))

    first = groups.withColumns({"limits": F.lit(None).cast("array<struct<at int, slot int, low long, high long>>"), "reach": F.lit(0.0)})
    with small_batches(spark, BATCH):
        near = stored(_cells(first, buckets, lanes).mapInPandas(_search(1, positives, True), FOUND), "positives-by-lane")
    nth = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id"))
    found = stored(near.withColumn("slot", nth - 1).where(F.col("slot") < positives), "positives")

    # the windows, in whole numbers: low * p <= 100 * n <= high * p
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    at_least, at_most = F.ceil(wide("score") * low / F.lit(100).cast("decimal(3,0)")), F.floor(wide("score") * high / F.lit(100).cast("decimal(3,0)"))
    windows = found.where("score >= 0").select("block", F.struct("at", F.col("slot").cast("int").alias("slot"), at_least.cast("long").alias("low"), at_most.cast("long").alias("high")).alias("w"))
    limits = windows.groupBy("block").agg(F.collect_list("w").alias("limits"))  # at most group_rows * positives
    second = stored(groups.join(limits, "block").mapInPandas(_reach, PACKED + ", limits array<struct<at int, slot int, low long, high long>>, reach double"), "anchors-with-limits")
    with small_batches(spark, BATCH):
        far = stored(_cells(second, buckets, lanes).mapInPandas(_search(positives, k, False), FOUND), "negatives-by-lane")
    for table in (buckets, near, second):
        drop_stored(table)
    names = groups.mapInPandas(_names, "block long, at int, anchor_id long")
    chosen = found.select("block", "at", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["block", "at"])
    met = chosen.join(far.select("block", "at", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["block", "at"])
    met = met.where((wide("negative_score") * 100 >= wide("positive_score") * low) & (wide("negative_score") * 100 <= wide("positive_score") * high))
    rank = F.row_number().over(Window.partitionBy("block", "at", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups with the length that a vector must have to reach the lowest window of any of their anchors."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            length = np.sqrt((_matrix(r.matrix, r.n, r.dim, r.dim).astype(np.float64) ** 2).sum(axis=1))
            out.append(min((w["low"] / length[w["at"]] if w["low"] > 0 else 0.0 for w in r.limits), default=0.0))
        yield batch.assign(reach=np.array(out, np.float64))


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            yield pd.DataFrame({"block": np.full(r.n, r.block), "at": np.arange(r.n, dtype=np.int32), "anchor_id": np.frombuffer(r.ids, np.int64)})


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
