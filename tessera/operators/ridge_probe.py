"""Multi-class linear probes over folds, from sums of products alone.

A pass sums products of features and classes by fold. What a fold's model is fitted on is the whole table's sums less the
fold's own, and standard scores of the rows outside the fold are a change of variables of these sums, so no row is
read again to fit, whatever the number of folds. Leaving out one row is taking its own products away, done where the row is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partial_sums import COLUMNS, PARTS, added, cut, whole


def feature_names(df: DataFrame, features: str) -> list[str]:
    """The keys that a column of maps has in any row, sorted; one name a feature comes to the driver."""
    return [r[0] for r in df.select(F.explode(F.map_keys(features)).alias("f")).distinct().orderBy("f").collect()]


def with_matrix(df: DataFrame, features: str, names: list[str], *, missing: bool = True) -> DataFrame:
    """df with `x`: the features of a map in order of names, 0 where one is missing or not finite, and, if asked for, as many flags of what is missing."""
    value = lambda n: F.try_element_at(F.col(features), F.lit(n)).cast("double")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    cells = [F.when(fine(value(n)), value(n)).otherwise(0.0) for n in names]
    flags = [F.when(fine(value(n)), 0.0).otherwise(1.0) for n in names] if missing else []
    return df.withColumn("x", F.array(*cells, *flags))


def _fitted(products: np.ndarray, targets: np.ndarray, counts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights by class, constants) of ridge models of +1 and -1 from sums: products of features and a constant with each other, of features
    with classes, and rows of each class. A constant feature has deviation 1."""
    n = max(products[-1, -1], 1.0)
    mean = products[:-1, -1] / n
    centred = products[:-1, :-1] - n * np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(centred) / n, 0.0))
    deviation = np.where(deviation < 1e-12 * np.maximum(1.0, np.abs(mean)), 1.0, deviation)
    y = 2 * counts / n - 1  # mean target of each class
    right = 2 * targets - products[:-1, -1][:, None]  # features with +1 and -1
    gram = centred / np.outer(deviation, deviation)
    weights = np.linalg.solve(gram + alpha * np.eye(len(mean)), (right - n * np.outer(mean, y)) / deviation[:, None])
    return mean, deviation, weights, y


def _products(x: np.ndarray, labels: np.ndarray, classes: int) -> np.ndarray:
    """Sums of products of rows with a constant at the end, of rows with classes, as one array."""
    both = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    one = np.zeros((len(x), classes))
    one[np.arange(len(x)), labels] = 1.0
    return np.concatenate([(both.T @ both).reshape(-1), (both.T @ one).reshape(-1)])


def probe(df: DataFrame, *, key: str, label: str, x: str = "x", fold: str | None = None, k: int = 0, alpha: float = 1.0, first: tuple[str, ...] = (), most_classes: int = 1000) -> DataFrame:
    """(key, label, fold, predicted, margin, scores) of rows that their model never saw: that of the rows outside their fold, or, without a fold, that
    of all other rows.

    A model is a ridge regression for each class against +1 and -1 on standard scores of its own rows, with an unpenalised constant. The class of the
    highest value wins, of equals the one that comes first: those of `first`, in their order, then the others sorted. margin is its lead over the second,
    null with one class. Rows of null label, fold or features are left out, as are those whose array holds a null or non-finite value. Classes and sums come to the
    driver: (features + 1) * (features + 1 + classes) numbers for each fold."""
    sound = F.forall("x_", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).alias("key_"), F.col(label).cast("string").alias("label_"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold_"), F.col(x).cast("array<double>").alias("x_")).where("label_ is not null and fold_ is not null and x_ is not null").where(sound)
    found = [r[0] for r in rows.select("label_").distinct().limit(most_classes + 1).collect()]
    if len(found) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    classes = [c for c in first if c in found] + sorted(c for c in found if c not in first)
    widths = [r[0] for r in rows.select(F.size("x_")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("rows have different numbers of features")
    kind = f"key_ {dict(rows.dtypes)['key_']}, label string, fold int, predicted string, margin double, scores map<string,double>"
    if not widths:
        return df.sparkSession.createDataFrame([], kind).withColumnRenamed("key_", key)
    width, number, folds = widths[0], {c: i for i, c in enumerate(classes)}, k if fold else 1
    size = (width + 1) * (width + 1 + len(classes))

    def matrix(batch: pd.DataFrame) -> np.ndarray:
        return np.stack(batch["x_"].to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, width))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, size))
        for batch in batches:
            m, y, f = matrix(batch), batch["label_"].map(number).to_numpy(np.int64), batch["fold_"].to_numpy()
            for g in np.unique(f):
                total[g] += _products(m[f == g], y[f == g], len(classes))
        yield pd.DataFrame([c for g in range(folds) for c in cut(g, total[g])], columns=COLUMNS)

    got = added(rows.mapInPandas(sums, PARTS))
    by_fold = np.array([whole(got, g, size) for g in range(folds)])
    shared = df.sparkSession.sparkContext.broadcast((by_fold.sum(axis=0), by_fold))

    def model(flat: np.ndarray):
        a, b = flat[: (width + 1) ** 2].reshape(width + 1, width + 1), flat[(width + 1) ** 2 :].reshape(width + 1, len(classes))
        return _fitted(a, b[:-1], b[-1], alpha)

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, parts = shared.value
        models: dict[int, tuple] = {}
        for batch in batches:
            m, y, f = matrix(batch), batch["label_"].map(number).to_numpy(np.int64), batch["fold_"].to_numpy()
            values = np.zeros((len(m), len(classes)))
            if fold:
                for g in np.unique(f):
                    if g not in models:
                        models[g] = model(total - parts[g])
                    mean, deviation, weights, constant = models[g]
                    values[f == g] = (m[f == g] - mean) / deviation @ weights + constant
            else:
                for i in range(len(m)):
                    mean, deviation, weights, constant = model(total - _products(m[i : i + 1], y[i : i + 1], len(classes)))
                    values[i] = (m[i] - mean) / deviation @ weights + constant
            best = values.argmax(axis=1) if len(m) else np.zeros(0, int)
            order = np.sort(values, axis=1)
            margin = order[:, -1] - order[:, -2] if len(classes) > 1 else [None] * len(m)
            yield pd.DataFrame({"key_": batch["key_"], "label": batch["label_"], "fold": f if fold else np.full(len(m), -1), "predicted": [classes[b] for b in best], "margin": margin, "scores": [dict(zip(classes, map(float, v), strict=True)) for v in values]})

    return rows.mapInPandas(predicted, kind).withColumnRenamed("key_", key)
