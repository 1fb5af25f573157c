"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of similar length. For a query q with a proven lower
bound t on its k-th best product, a bucket whose longest vector has length L can only matter when its local
cosine threshold c = t / (|q| L) is at most 1. Inside a bucket either the length bound (only the prefix of
vectors at least t / |q| long) or the coordinate bound (only vectors whose normalised focus coordinates lie
in the interval that a cosine of c allows) makes the candidates, whichever keeps fewer; their products are
then computed exactly. The first bound t comes from the bucket of longest vectors; it rises while a task
works through its buckets.

Cost at scale: vectors are shuffled once (range by length, packed into blocks), and each block of queries
goes once to each of `lanes` tasks. The driver gets the block of longest vectors, which is of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Scores beyond this don't fit their type.
LIMIT = 2**63 - 1
#: How much dearer a candidate of the coordinate bound is than a row of the dense product.
COORDINATE_COST = 12
#: Coordinates of largest weight in the query that the coordinate bound looks at.
FOCUS = 3

#: Query blocks whose risen bounds a task remembers.
BLOCKS = 4096

PACKED = "bucket long, longest double, n int, dim int, ids binary, matrix binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) for each component x as double, in 64 bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _bytes(matrix: np.ndarray) -> bytes:
    """32-bit integers where all fit, else 64-bit ones."""
    small = np.iinfo(np.int32)
    return matrix.astype(np.int32 if small.min <= matrix.min(initial=0) and matrix.max(initial=0) <= small.max else np.int64).tobytes()


def _matrix(data: bytes, n: int, dim: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.int64)
    out[:, :dim] = np.frombuffer(data, np.int64 if len(data) == 8 * n * dim else np.int32).reshape(n, dim)
    return out


def _pack(rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, serial, kept = TaskContext.get().partitionId(), 0, []

        def block(ids, vectors):
            nonlocal serial
            dim = max((len(v) for v in vectors), default=0)
            matrix = np.zeros((len(vectors), dim), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            longest = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
            serial += 1
            return pd.DataFrame({"bucket": [(part << 32) + serial], "longest": [longest], "n": [len(ids)], "dim": [dim], "ids": [np.asarray(ids, np.int64).tobytes()], "matrix": [_bytes(matrix)]})

        for batch in batches:
            kept += zip(batch["vec_id"], batch["v"], strict=True)
            while len(kept) >= rows:
                yield block(*zip(*kept[:rows], strict=True))
                kept = kept[rows:]
        if kept:
            yield block(*zip(*kept, strict=True))

    return pack


class Bucket:
    """A block of vectors, longest first, with what both bounds need."""

    def __init__(self, ids: bytes, matrix: bytes, n: int, dim: int, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        whole = _matrix(matrix, n, dim, width)
        self.rows = whole.astype(np.float64)
        self.length = np.sqrt((self.rows**2).sum(axis=1))
        order = np.argsort(-self.length, kind="stable")
        self.ids, self.rows, self.length = self.ids[order], self.rows[order], self.length[order]
        self.top, self._sorted = np.abs(self.rows).max(initial=0.0), {}
        self._whole = whole, order

    def whole(self) -> np.ndarray:
        """The rows in 64-bit integers."""
        matrix, order = self._whole
        return matrix[order]

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Normalised coordinate f of all vectors, ascending, and the rows in that order."""
        if f not in self._sorted:
            unit = self.rows[:, f] / np.maximum(self.length, 1e-300)
            order = np.argsort(unit, kind="stable")
            self._sorted[f] = (unit[order], order)
        return self._sorted[f]


def _interval(cosine: float, x: float) -> tuple[float, float]:
    """Values that a coordinate of a unit vector may take when its cosine with a unit query is at least `cosine` and the query's coordinate is x."""
    reach = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - x * x)))
    low = -1.0 if x <= -cosine else cosine * x - reach
    high = 1.0 if x >= cosine else cosine * x + reach
    return low - 1e-9, high + 1e-9


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_bucket(b: Bucket, queries: np.ndarray, qids: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores) of the candidates that may still be among the k best. Raises no bound that isn't proven."""
    whole_queries, queries = queries, queries.astype(np.float64)
    # below 2**53 doubles hold products exactly; beyond, 64-bit integers do, and Python's own after that
    most = max(b.top, 1) * max(np.abs(queries).max(initial=0.0), 1) * max(queries.shape[1], 1)
    if most < 2.0**53:
        kept, asked = b.rows, queries
    else:
        kind = np.int64 if most < 2.0**62 else object
        kept, asked = b.whole().astype(kind), whole_queries.astype(np.int64).astype(kind)

    def fitting(scores: np.ndarray) -> np.ndarray:
        return (np.clip(scores, -LIMIT, LIMIT) if scores.dtype == object else scores).astype(np.int64)

    lengths = np.sqrt((queries**2).sum(axis=1))
    longest = b.length[0] if len(b.length) else 0.0
    dense, few = [], {}
    for i, t in enumerate(bound):
        scale = lengths[i] * longest
        if t > scale * (1 + 1e-9) and t > 0:
            continue  # no vector here is long enough
        reach = len(b.ids)
        if t > 0:
            reach = int(np.searchsorted(-b.length, -(t / lengths[i]) * (1 - 1e-9), side="right"))
            cosine = min(1.0, t / scale)
            unit = queries[i] / lengths[i]
            spans = []
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                low, high = _interval(cosine, unit[f])
                values, order = b.coordinate(int(f))
                spans.append((int(np.searchsorted(values, low)), int(np.searchsorted(values, high, side="right")), low, high, int(f), order))
            spans.sort(key=lambda s: s[1] - s[0])
            if spans and (spans[0][1] - spans[0][0]) * COORDINATE_COST < reach:
                rows = spans[0][5][spans[0][0] : spans[0][1]]
                rows = rows[rows < reach]
                for _, _, low, high, f, _ in spans[1:]:
                    x = b.rows[rows, f] / np.maximum(b.length[rows], 1e-300)
                    rows = rows[(x >= low) & (x <= high)]
                few[i] = rows
                continue
        if reach:
            dense.append((i, reach))
    for i, rows in few.items():
        yield i, b.ids[rows], fitting(kept[rows] @ asked[i])
    for start in range(0, len(dense), 256):
        part = dense[start : start + 256]
        top = max(r for _, r in part)
        at = [i for i, _ in part]
        scores = kept[:top] @ asked[at].T
        for j, (i, reach) in enumerate(part):
            yield i, b.ids[:reach], fitting(scores[:reach, j])


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        risen: dict[int, np.ndarray] = {}  # of each query block, the bounds found so far
        for batch in batches:
            for r in batch.itertuples(index=False):
                width = max(r.dim, r.q_dim)
                b = Bucket(r.ids, r.matrix, r.n, r.dim, width)
                qids = np.frombuffer(r.q_ids, np.int64)
                queries = _matrix(r.q_matrix, r.q_n, r.q_dim, width)
                bound = np.full(r.q_n, -np.inf)
                if r.q_bound is not None:
                    bound = np.frombuffer(r.q_bound, np.float64)
                if len(risen) > BLOCKS:
                    risen.clear()  # a bound that is forgotten costs time, not results
                found = risen.setdefault(r.q_bucket, np.full(r.q_n, -np.inf))
                bound = np.maximum(bound, found)
                out_q, out_v, out_s = [], [], []
                for i, ids, scores in search_bucket(b, queries, qids, bound, k):
                    keep = (ids != qids[i]) & (scores >= bound[i])
                    ids, scores = ids[keep], scores[keep]
                    top = best(ids, scores, k)
                    if len(top) == k:
                        found[i] = max(found[i], float(scores[top[-1]]))
                    out_q.append(np.full(len(top), qids[i]))
                    out_v.append(ids[top])
                    out_s.append(scores[top])
                if out_q:
                    yield pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return search


def _bounds(k: int, head):
    """Query blocks with each query's k-th best product within the bucket of longest vectors, which `head` is a broadcast of."""
    run = _search(k)

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                block = batch.iloc[i : i + 1].reset_index(drop=True)
                pair = block.assign(**{name: [value] for name, value in head.value.items()}, q_bound=None)
                found = pd.concat([pd.DataFrame({"query_id": [], "score": []}), *run(iter([pair]))])
                kth = found.groupby("query_id")["score"].agg(lambda s: s.min() if len(s) >= k else -np.inf)
                ids = np.frombuffer(block["q_ids"][0], np.int64)
                yield block.assign(q_bound=[kth.reindex(ids).fillna(-np.inf).to_numpy(np.float64).tobytes()])

    return bounds


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = 4096, query_rows: int = 1024, lanes: int | None = None) -> DataFrame:
    """The k highest integer inner products of each query row with every other row.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer candidates;
    ties go to the smaller vec_id. `queries` is a condition on the id column.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part.
    Every row counts, as candidate and as query, whether or not others share its id: an id's results are the best pairs
    of any of its rows with rows of other ids, so a vec_id may come more than once. A shorter vector is padded with zeros. Products are exact; quantised components and scores that
    64 bits don't hold are held at the ends of their type. An empty table gives no rows. Columns other than
    the two named are not read.
    """
    spark = vectors.sparkSession
    whole = F.forall(F.col("raw"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw")).where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows.select("vec_id", quantised(F.col("raw"), scale).alias("v"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    blocks = stored(rows.repartitionByRange(F.desc("norm"), F.asc("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "v").mapInPandas(_pack(bucket_rows), PACKED), "buckets")
    asked = rows.where(queries).select("vec_id", "v").mapInPandas(_pack(query_rows), PACKED)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("bucket", "n", "dim", "ids", "matrix")])
    # one row of bounded size: the bucket of longest vectors
    head = [r.asDict() for r in blocks.orderBy(F.desc("longest"), "bucket").limit(1).collect()]
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shared = spark.sparkContext.broadcast({name: bytes(x) if isinstance(x, bytearray) else x for name, x in head[0].items()})
    seeded = stored(asked.mapInPandas(_bounds(k, shared), "q_bucket long, q_n int, q_dim int, q_ids binary, q_matrix binary, q_bound binary"), "queries")
    lanes = lanes or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = blocks.withColumn("lane", F.pmod(F.xxhash64("bucket"), F.lit(lanes)))
    right = seeded.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # merged, since both sides grow with the table: by the size of a block before its copies the planner would broadcast every lane's
    found = left.join(right.hint("merge"), "lane").drop("lane").mapInPandas(_search(k), "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
