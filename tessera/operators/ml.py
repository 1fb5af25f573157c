"""Fold-safe features and linear models. What is fitted comes from training rows only.

Ridge needs one pass: the Gram matrix is an aggregate and its solution is a small problem on the driver. Logistic
models are fitted by Newton steps whose gradients are aggregates too, so rows are never gathered."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged
from .stats import auroc


#: Weights that a task writes out at once.
WEIGHTS = 100_000


def tfidf(df: DataFrame, key: str, text: str, *, train: Column | None = None, least_docs: int = 2, most_terms: int = 50_000, unit: str = "word", sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * idf over words and word pairs, or with unit="char" over runs of sizes[0] to sizes[1] characters
    within words that have a space on either side, each row of length 1.

    idf = ln((1 + n) / (1 + df)) + 1 over training rows; terms in fewer than least_docs of them are left out, and of
    the others the most_terms most frequent stay (ties by term).

    What is shuffled are texts and the document counts of terms: a task counts and weighs the terms of its keys in batches. The terms that
    stay come to the driver and go to every task."""
    from .terms import counted, lengths, places, slices, words

    # the texts of a key lie in one row, with a null after the words of each; rows of a key that train and those that don't are counted apart
    flag = train if train is not None else F.lit(True)
    texts = df.select(F.col(key).alias("key_"), F.coalesce(flag, F.lit(False)).alias("train_"), F.coalesce(F.col(text), F.lit("")).alias("text_")).repartition(F.col("key_"))
    of = lambda trains: F.flatten(F.transform(F.filter("texts_", lambda t: t["train_"] == trains), lambda t: F.array_append(words(t["text_"], unit), F.lit(None))))
    keyed = texts.groupBy("key_").agg(F.collect_list(F.struct("train_", "text_")).alias("texts_"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", unit):
                for names, _, term, _ in counted(part.column("t"), unit, sizes):
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names)))], names=["term", "df"])

    seen = keyed.select(of(True).alias("t")).mapInArrow(documents, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    best = seen.orderBy(F.desc("df"), "term").limit(most_terms).toArrow()
    n = df.where(flag).count()
    shared = df.sparkSession.sparkContext.broadcast((best.column("term").combine_chunks(), np.log((1 + n) / (1 + best.column("df").to_numpy())) + 1))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in batches:
            for part in slices(batch, "t", unit):
                found = [[], [], []]
                for c in ("t", "u"):
                    for names, row, term, tf in counted(part.column(c), unit, sizes):
                        at = places(names, terms)[term]
                        for x, y in zip(found, (row, at, tf), strict=True):
                            x.append(y[at >= 0])
                row, at, tf = (np.concatenate(x) for x in found)
                order = np.argsort(row, kind="stable")
                row, at, tf = row[order], at[order], tf[order]
                weight = (1 + np.log(tf)) * idf[at]
                weight /= lengths(weight, row, part.num_rows)[row]
                for i in range(0, len(row), WEIGHTS):
                    cut = slice(i, i + WEIGHTS)
                    yield pa.RecordBatch.from_arrays([part.column("key_").take(pa.array(row[cut])), terms.take(pa.array(at[cut])), pa.array(weight[cut])], names=[key, "term", "weight"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    return keyed.select("key_", of(True).alias("t"), of(False).alias("u")).mapInArrow(weighed, f"`{key}` {kind}, term string, weight double")


def word_terms(text: Column) -> Column:
    """Words of two letters or more in lower case, and pairs of words next to each other."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of low to high characters of the words of the lower-cased text, with a space on either side of a word."""
    return _char_grams(F.lower(text), low, high)


def _char_grams(text: Column, low: int, high: int) -> Column:
    """Runs of low to high characters of each word with a space on either side; a word shorter than a run counts once, whole."""

    def run_of(w: Column, size: int):
        return lambda i: F.substring(w, i, F.lit(size))

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(w)
        runs = []
        for size in range(low, high + 1):
            starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
            runs.append(F.when((n >= size) | F.lit(size == low), F.transform(starts, run_of(w, size))).otherwise(F.array().cast("array<string>")))
        return F.concat(*runs)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), of))


def scaled_block(df: DataFrame, columns: list[str], *, train: Column | None = None) -> DataFrame:
    """df with `block`: z-scores by training rows over the square root of their number; 0 for a constant or missing value."""
    base = df.where(train) if train is not None else df
    stats = base.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    values = []
    for c in columns:
        sd = F.when(F.col(f"{c}__sd") < 1e-12, 1.0).otherwise(F.col(f"{c}__sd"))
        values.append(F.coalesce(F.nanvl((F.col(c).cast("double") - F.col(f"{c}__mu")) / sd, F.lit(None)), F.lit(0.0)) / F.sqrt(F.lit(float(len(columns)))))
    return out.select(*df.columns, F.array(*values).alias("block"))


def matrix(df: DataFrame, key: str, features: str) -> DataFrame:
    """(key, feature, value, is_missing) for every key and every feature name that any row has; missing values are 0."""
    cells = df.select(key, F.explode(features).alias("feature", "v"))
    names = cells.select("feature").distinct()
    every = df.select(key).join(F.broadcast(names))
    clean = F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))
    return every.join(cells, [key, "feature"], "left").select(key, "feature", F.coalesce(clean, F.lit(0.0)).alias("value"), clean.isNull().cast("int").alias("is_missing"))


def _gram(df: DataFrame, columns: list[str], target: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the columns (and a constant) with each other and with the target, in one aggregate."""
    x = [F.col(c).cast("double") for c in columns] + [F.lit(1.0)]
    w = weight if weight is not None else F.lit(1.0)
    n = len(x)
    aggs = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(w * x[i] * target).alias(f"t{i}") for i in range(n)]
    r = df.agg(*aggs).collect()[0]
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, np.array([r[f"t{i}"] or 0.0 for i in range(n)])


def linear(columns: list[str], weights) -> Column:
    """The value of a linear model whose last weight is the constant."""
    out = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights, strict=False):
        out = out + F.col(c).cast("double") * float(w)
    return out


def ridge(df: DataFrame, columns: list[str], target: Column, alpha: float = 1.0) -> np.ndarray:
    """Weights of a ridge regression, the constant last and unpenalised."""
    g, t = _gram(df, columns, target)
    return np.linalg.pinv(g + alpha * np.diag([1.0] * len(columns) + [0.0])) @ t


def ridge_classes(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0) -> dict[str, np.ndarray]:
    """One ridge model a class, against +1 and -1."""
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return {c: ridge(df, columns, F.when(F.col(label) == c, 1.0).otherwise(-1.0), alpha) for c in labels}


def predicted_class(columns: list[str], models: dict[str, np.ndarray]) -> Column:
    """The class with the largest value; ties go to the class that comes first."""
    best = [F.struct(linear(columns, w).alias("v"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, w) in enumerate(models.items())]
    return F.greatest(*best)["c"] if len(best) > 1 else best[0]["c"]


def logistic(df: DataFrame, columns: list[str], label: str, *, c: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression with penalty |w|^2 / (2 c) on all weights, the constant too; the loss is a sum."""
    w = np.zeros(len(columns) + 1)
    rows = df.select(*columns, F.col(label).cast("double").alias("y_")).cache()
    try:
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-linear(columns, w)))
            hess, _ = _gram(rows, columns, F.lit(0.0), p * (1 - p))
            _, grad = _gram(rows, columns, F.col("y_") - p)
            step = np.linalg.solve(hess + np.eye(len(w)) / c, grad - w / c)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
    finally:
        rows.unpersist()
    return w


def out_of_fold(df: DataFrame, columns: list[str], label: str, fold: str, k: int, fit=logistic, **options) -> DataFrame:
    """df with `oof`: the value of the model fitted without the row's own fold."""
    out = F.lit(None).cast("double")
    for i in range(k):
        w = fit(df.where(F.col(fold) != i), columns, label if fit is logistic else F.col(label).cast("double"), **options)
        out = F.when(F.col(fold) == i, linear(columns, w)).otherwise(out)
    return df.withColumn("oof", out)


def chosen_penalty(df: DataFrame, columns: list[str], label: str, fold: str, k: int, grid: list[float]) -> float:
    """The penalty of the grid with the best mean AUROC over inner folds, the first of equals; 1.0 when no fold has both classes."""
    best, value = 1.0, -1.0
    for c in grid:
        found = auroc(out_of_fold(df, columns, label, fold, k, c=c), "oof", label, [fold]).agg(F.avg("auroc")).collect()[0][0]
        if found is not None and found > value + 1e-12:
            best, value = c, found
    return best


def _merged(blocks: list[list[float]], rows: Iterable) -> list[list[float]]:
    """Pool-adjacent-violators: rows (low, high, sum, weight) in order of x, added to the blocks before them."""
    for low, high, total, weight in rows:
        while blocks and blocks[-1][2] / blocks[-1][3] >= total / weight:
            low, _, t, w = blocks.pop()
            total, weight = t + total, w + weight
        blocks.append([low, high, total, weight])
    return blocks


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over (x, y, weight): (x, fitted) with equal x pooled first."""
    pooled: dict[float, list[float]] = {}
    for x, y, w in points:
        cell = pooled.setdefault(x, [0.0, 0.0])
        cell[0] += y * w
        cell[1] += w
    xs, blocks = sorted(pooled), _merged([], ((x, x, *pooled[x]) for x in sorted(pooled)))
    return [(x, total / weight) for low, high, total, weight in blocks for x in xs[bisect_left(xs, low) : bisect_right(xs, high)]]


def _merged_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blocks: list[list[float]] = []
    for batch in batches:
        _merged(blocks, batch.itertuples(index=False))
    yield pd.DataFrame(blocks, columns=["low", "high", "total", "weight"]).astype("float64")


def isotonic_calibrated(df: DataFrame, score: str, label: str, *, train: Column) -> DataFrame:
    """df with `calibrated`: an isotonic fit on training rows, linear between points, constant outside.

    The fit is exact at every size: labels are summed by score, violators are merged within range partitions of the
    scores, and once more over the blocks that remain, in one task. Each distinct score then meets the blocks beside it
    in range partitions. Rows without a score get null; training rows without a label take no part."""
    rows = df.where(train & F.col(score).isNotNull() & F.col(label).isNotNull())
    sums = rows.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y")).groupBy("low").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    schema = "low double, high double, total double, weight double"
    parts = sums.select("low", F.col("low").alias("high"), "total", "weight").repartitionByRange("low").sortWithinPartitions("low").mapInPandas(_merged_batches, schema)
    blocks = parts.repartition(1).sortWithinPartitions("low").mapInPandas(_merged_batches, schema)
    y = F.col("total") / F.col("weight")
    ends = blocks.select(F.explode(F.array("low", "high")).alias("x_"), y.alias("y_"))
    asked = df.select(F.col(score).cast("double").alias("x_"), F.lit(None).cast("double").alias("y_")).where(F.col("x_").isNotNull())
    spread = ranged(asked.distinct().unionByName(ends).groupBy("x_").agg(F.max("y_").alias("y_")), [F.asc("x_")])
    point = F.when(F.col("y_").isNotNull(), F.struct(F.col("x_").alias("x"), F.col("y_").alias("y")))
    ordered = Window.orderBy("pid_")
    beside = spread.groupBy("pid_").agg(F.min(point).alias("first_"), F.max(point).alias("last_")).select(
        "pid_", F.last("last_", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"),
        F.last("first_", ignorenulls=True).over(Window.orderBy(F.desc("pid_")).rowsBetween(Window.unboundedPreceding, -1)).alias("after_"),
    )
    near = lambda order: F.last(point, ignorenulls=True).over(Window.partitionBy("pid_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    local = spread.withColumns({"low_": near(F.asc("x_")), "high_": near(F.desc("x_"))}).join(F.broadcast(beside), "pid_")
    low, high = F.coalesce("low_", "before_"), F.coalesce("high_", "after_")
    line = F.when(high["x"] == low["x"], low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (F.col("x_") - low["x"]) / (high["x"] - low["x"]))
    fitted = local.select("x_", F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(line).alias("c_"))
    return df.join(fitted, F.col(score).cast("double") == F.col("x_"), "left").withColumn("calibrated", F.col("c_")).drop("x_", "c_")


def first_component(df: DataFrame, vector: str, width: int) -> tuple[np.ndarray, float]:
    """First principal direction of vectors and its share of variance."""
    from .directions import principal

    found = principal(df, vector, width)
    return (found.vectors[0], float(found.shares[0])) if len(found.vectors) else (np.zeros(width), 0.0)
