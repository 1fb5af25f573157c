"""Directions of wide vectors: means, principal components and those without a row; controls by rows that changed partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged
from .partial_sums import COLUMNS, PARTS, added, cut, whole
from .sampling import order_of


@dataclass
class Directions:
    """What `principal` finds: number of rows, their mean, orthonormal directions (one a row), the variance along each, and in all."""

    rows: int
    mean: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))


def _matrix(batch: pd.DataFrame, width: int) -> np.ndarray:
    return np.stack(batch["v_"].to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, width))


def _vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    sound = F.forall("v_", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vector).cast("array<double>").alias("v_")).where((F.size("v_") == width) & sound)


def principal(df: DataFrame, vector: str, width: int, k: int = 1, *, reference: np.ndarray | None = None, spare: int = 8, rounds: int = 100, tolerance: float = 1e-9, seed: int = 0) -> Directions:
    """The k directions of largest variance, by block power iteration.

    A round is one pass: each task multiplies its centred rows with k + spare directions and back, so it sends width by (k + spare) sums,
    never width by width. It ends when the k variances move by less than `tolerance` of their size. With spare directions the k-th converges as the
    ratio of the variance after the spare ones to its own. Vectors of another length, or with a null or non-finite component, are
    left out. Signs: along `reference` where given, else the largest component is positive. Fewer rows or columns than k give fewer."""
    held = _vectors(df, vector, width)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(width), 0
        for batch in batches:
            total += _matrix(batch, width).sum(axis=0)
            n += len(batch)
        yield pd.DataFrame(cut(0, np.append(total, n)), columns=COLUMNS)

    both = whole(added(held.mapInPandas(sums, PARTS)), 0, width + 1)
    n = int(both[-1])
    if n == 0:
        return Directions(0, np.zeros(width), np.zeros((0, width)), np.zeros(0), 0.0)
    mean = both[:-1] / n
    block = min(k + spare, width)

    def passed(basis: np.ndarray | None):
        shared = df.sparkSession.sparkContext.broadcast((mean, basis))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, q = shared.value
            total = np.zeros((width, q.shape[1]))
            square = 0.0
            for batch in batches:
                x = _matrix(batch, width) - centre
                total += x.T @ (x @ q)
                square += float((x * x).sum())
            yield pd.DataFrame(cut(0, np.append(total.reshape(-1), square)), columns=COLUMNS)

        out = whole(added(held.mapInPandas(run, PARTS)), 0, width * block + 1)
        shared.unpersist()
        return out[:-1].reshape(width, block) / n, float(out[-1]) / n

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    before = np.full(block, np.inf)
    for _ in range(rounds):
        product, total = passed(q)
        # within the block, the directions themselves
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        order = np.argsort(-values)
        values, found = values[order], (q @ turn)[:, order]
        if total <= 0 or np.abs(values[:k] - before[:k]).max() <= tolerance * max(float(values[0]), 1e-300):
            break
        before, q = values, np.linalg.qr(product @ turn[:, order])[0]
    kept = values[:k] > 1e-12 * max(total, 1e-300)
    vectors, values = found[:, :k].T[kept], values[:k][kept]
    for v in vectors:
        at = float(v @ reference) if reference is not None else v[np.abs(v).argmax()]
        if at < 0:
            v *= -1
    return Directions(n, mean, vectors, values, total)


def without_each(df: DataFrame, key: str, vector: str, width: int, *, rank: int = 16, **options) -> DataFrame:
    """(key, mean, component): for each row the mean of the other rows, and the first principal direction of the others along that mean.

    Both come from the whole table by taking the row out: the mean as (n * mean - x) / (n - 1); the direction as that of the covariance less the
    row's part, which lies in the span of the leading `rank` directions and the row. What is beyond `rank` directions is taken as
    even, so the direction is exact where the rows' variance has at most `rank` directions, and close where the rest is small. With fewer
    than three others the direction is the mean; alone, a row has neither."""
    whole_table = principal(df, vector, width, min(rank, width), **options)
    n, r = whole_table.rows, len(whole_table.vectors)
    rest = max(0.0, whole_table.total - float(whole_table.variances.sum())) / max(1, width - r)
    shared = df.sparkSession.sparkContext.broadcast((whole_table.mean, whole_table.vectors, whole_table.variances))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, basis, variances = shared.value
        for batch in batches:
            x = _matrix(batch, width)
            if n < 2:
                yield pd.DataFrame({key: batch[key], "mean": [None] * len(batch), "component": [None] * len(batch)})
                continue
            others = (n * mean - x) / (n - 1)
            u = x - mean
            inside = u @ basis.T
            left = u - inside @ basis
            length = np.sqrt((left * left).sum(axis=1))
            a = np.concatenate([inside, length[:, None]], axis=1)
            m = np.zeros((len(x), r + 1, r + 1))
            m[:, np.arange(r + 1), np.arange(r + 1)] = np.append(variances, rest)
            m -= a[:, :, None] * a[:, None, :] / (n - 1)
            top = np.linalg.eigh(m)[1][:, :, -1] if len(x) else np.zeros((0, r + 1))
            out = top[:, :r] @ basis + top[:, r:] * left / np.maximum(length, 1e-300)[:, None]
            out *= np.where((out * others).sum(axis=1) < 0, -1.0, 1.0)[:, None]
            yield pd.DataFrame({key: batch[key], "mean": list(others), "component": list(out if n > 3 else others)})

    sound = F.forall("v_", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(key, F.col(vector).cast("array<double>").alias("v_")).where((F.size("v_") == width) & sound)
    return rows.mapInPandas(run, f"`{key}` {kind}, mean array<double>, component array<double>")


def partnered(df: DataFrame, by: list[str], key: str, columns: list[str], seed: int = 0) -> DataFrame:
    """df with other_<column>: the values of the next row of the group in hash order, the first row's for the last. No row meets itself; a
    row alone in its group has null. Every row is met once.

    However large a group is, no task holds it: rows meet the next of their range, and the last of a range the first of the next."""
    held = ranged(df, [*[F.asc_nulls_first(F.col(b)) for b in by], order_of(key, seed).asc(), F.asc(key)])
    given = F.struct(*[F.col(c).alias(c) for c in columns])
    parts = held.groupBy(*[F.col(b).alias(f"{b}_g") for b in by], F.col("pid_").alias("part_")).agg(F.min_by(given, "ln_").alias("first_"), F.count(F.lit(1)).alias("c_"))
    over = Window.partitionBy(*[f"{b}_g" for b in by]).orderBy("part_")
    parts = parts.withColumns({"next_": F.coalesce(F.lead("first_").over(over), F.first("first_").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "all_": F.sum("c_").over(Window.partitionBy(*[f"{b}_g" for b in by]))})
    same = F.col("pid_") == F.col("part_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_g"))
    after = F.lead(given).over(Window.partitionBy(*by, "pid_").orderBy("ln_"))
    met = held.withColumn("after_", after).join(parts, same).withColumn("o_", F.when(F.col("all_") > 1, F.coalesce("after_", "next_")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("o_")[c].alias(f"other_{c}") for c in columns])


def percentile_among(df: DataFrame, by: list[str], key: str, x: str, y: str, value: Callable[[Column, Column], Column], rounds: int = 19, seed: int = 0) -> DataFrame:
    """One row: rows, observed (mean of value(x, y) over rows), and the share of rounds whose mean, with y of another row of the group, is at or below it.

    Round r partners rows in the hash order of seed + r. Rows whose group has no other are left out of both."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key, F.col(x).alias("x_"), F.col(y).alias("y_"))
    means = None
    for r in range(rounds):
        met = partnered(rows, by, key, ["y_"], seed + r).where(F.col("other_y_").isNotNull())
        one = met.agg(F.count(F.lit(1)).alias("rows"), F.avg(value(F.col("x_"), F.col("y_"))).alias("observed"), F.avg(value(F.col("x_"), F.col("other_y_"))).alias("control"))
        means = one if means is None else means.unionByName(one)
    return means.agg(F.first("rows").alias("rows"), F.first("observed").alias("observed"), F.avg("control").alias("mean_control"), F.avg((F.col("control") <= F.col("observed")).cast("double")).alias("percentile"))
