"""Evaluation ladders: many logistic models over the same folds, fitted together.

A rung is a choice of features. All models (rung and fold, and those nested in a fold) take their Newton steps at once: a
step is one pass over the rows, in which each task sums the gradient and the matrix of second derivatives of every model
over its rows. Spark adds up what the tasks send, and the driver gets one small matrix a model, whatever the number of tasks. Rows are
never gathered or copied by model. For text and other sparse features see `sparse`."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop_stored, stored
from .partial_sums import COLUMNS, PARTS, added, cut, whole


@dataclass
class Fit:
    """A model: which features it reads, which rows it leaves out (by fold), and its penalty, as 1 / (2 c) |w|^2."""

    features: list[int]
    without: tuple[int, ...]
    c: float = 1.0


def _sums(fits: list[Fit], weights: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [(np.zeros((len(w), len(w))), np.zeros(len(w))) for w in weights]
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x_"].to_numpy()).astype(np.float64)
            y, fold = batch["y_"].to_numpy(np.float64), batch["f_"].to_numpy(np.int64)
            for fit, w, (hess, grad) in zip(fits, weights, total, strict=True):
                keep = ~np.isin(fold, fit.without)
                a = np.concatenate([x[keep][:, fit.features], np.ones((int(keep.sum()), 1))], axis=1)
                p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
                hess += (a * (p * (1 - p))[:, None]).T @ a
                grad += a.T @ (y[keep] - p)
        yield pd.DataFrame([c for i, (h, g) in enumerate(total) for c in cut(i, np.append(h.reshape(-1), g))], columns=COLUMNS)

    return run


def fitted(df: DataFrame, x: str, label: str, fold: str, fits: list[Fit], rounds: int = 12) -> list[np.ndarray]:
    """Weights of each model, the constant last. Rows without a label, or with a null or non-finite feature, take no part. The rows are stored
    once for all steps. Models that still move when the rounds are over are named in a warning."""
    fine = F.forall(F.col("x_"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(x).cast("array<double>").alias("x_"), F.col(label).cast("double").alias("y_"), F.col(fold).cast("int").alias("f_")).where("y_ is not null and f_ is not null").where(fine)
    weights = [np.zeros(len(f.features) + 1) for f in fits]
    rows = stored(rows, "ladder")
    for _ in range(rounds):
        found = added(rows.mapInPandas(_sums(fits, weights), PARTS))
        moved = {}
        for i, fit in enumerate(fits):
            n = len(weights[i])
            both = whole(found, i, n * n + n)
            step = np.linalg.solve(both[: n * n].reshape(n, n) + np.eye(n) / fit.c, both[n * n :] - weights[i] / fit.c)
            weights[i] = weights[i] + step
            moved[i] = float(np.abs(step).max())
        if max(moved.values(), default=0.0) < 1e-8:
            break
    else:
        late = [i for i, m in moved.items() if m >= 1e-8] if rounds else []
        if late:
            warnings.warn(f"{len(late)} of {len(fits)} models still move after {rounds} rounds, by {max(moved.values()):.1e} at most, the first being {fits[late[0]]}", stacklevel=2)
    drop_stored(rows)
    return weights


def value(x: str, fit: Fit, weights: np.ndarray) -> Column:
    """The linear value of a model."""
    out = F.lit(float(weights[-1]))
    for i, w in zip(fit.features, weights, strict=False):
        out = out + F.col(x)[i].cast("double") * float(w)
    return out


def specs(blocks: dict[str, int]) -> dict[str, list[int]]:
    """Rungs of named blocks of features, given by their widths in the order of the feature array: each block by itself, and all of them."""
    out, at = {}, 0
    for name, width in blocks.items():
        out[name] = list(range(at, at + width))
        at += width
    return out | ({"all": list(range(at))} if len(blocks) > 1 else {})


def out_of_fold(df: DataFrame, x: str, label: str, fold: str, k: int, rungs: dict[str, list[int]], *, c: float = 1.0, rounds: int = 12) -> DataFrame:
    """df with oof_<rung>: the value of the rung's model that was fitted without the row's fold. All rungs share the folds."""
    fits = [Fit(features, (f,), c) for features in rungs.values() for f in range(k)]
    weights = fitted(df, x, label, fold, fits, rounds)
    out = {}
    for j, name in enumerate(rungs):
        col = F.lit(None).cast("double")
        for f in range(k):
            col = F.when(F.col(fold) == f, value(x, fits[j * k + f], weights[j * k + f])).otherwise(col)
        out[f"oof_{name}"] = col
    return df.withColumns(out)


def late_fusion(df: DataFrame, x: str, label: str, fold: str, k: int, one: list[int], two: list[int], *, c: float = 1.0, rounds: int = 12, name: str = "oof_late_fusion") -> DataFrame:
    """df with the value of a meta model over two models' scores, strictly nested: for each fold the meta model is fitted on scores of
    models that saw neither the fold nor the scored row's own."""
    if k < 3:
        raise ValueError("late fusion needs three folds: one held out, one scored, one to fit on")
    base = [Fit(features, without, c) for features in (one, two) for f in range(k) for without in [(f,), *[(f, g) for g in range(k) if g != f]]]
    weights = fitted(df, x, label, fold, base, rounds)
    at = {(tuple(b.features), b.without): value(x, b, w) for b, w in zip(base, weights, strict=True)}
    cells = []
    for f in range(k):
        for features in (one, two):
            col = at[tuple(features), (f,)]  # for the rows of the fold itself
            for g in range(k):
                if g != f:
                    col = F.when(F.col(fold) == g, at[tuple(features), (f, g)]).otherwise(col)
            cells.append(col)
    rows = df.withColumn("meta_", F.array(*cells))
    fits = [Fit([2 * f, 2 * f + 1], (f,), c) for f in range(k)]
    meta = fitted(rows, "meta_", label, fold, fits, rounds)
    col = F.lit(None).cast("double")
    for f in range(k):
        col = F.when(F.col(fold) == f, value("meta_", fits[f], meta[f])).otherwise(col)
    return rows.withColumn(name, col).drop("meta_")


def best_penalty(df: DataFrame, x: str, label: str, fold: str, k: int, features: list[int], grid: list[float], rounds: int = 12) -> float:
    """The penalty of the grid with the best mean AUROC over folds, the first of equals; 1.0 when no fold has both classes. All are fitted together."""
    from .stats import auroc

    fits = [Fit(features, (f,), c) for c in grid for f in range(k)]
    weights = fitted(df, x, label, fold, fits, rounds)
    cells = [F.struct(F.lit(j).alias("c"), F.lit(f).alias("f"), value(x, fits[j * k + f], weights[j * k + f]).alias("v")) for j in range(len(grid)) for f in range(k)]
    long = df.select(F.col(label).alias("y"), F.col(fold).alias("fold"), F.inline(F.array(*cells))).where("fold = f")
    found = {r["c"]: r["a"] for r in auroc(long, "v", "y", ["c", "f"]).groupBy("c").agg(F.avg("auroc").alias("a")).collect()}
    best, top = 1.0, -1.0
    for j, c in enumerate(grid):
        if found.get(j) is not None and found[j] > top + 1e-12:
            best, top = c, found[j]
    return best
