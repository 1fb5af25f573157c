"""Ranks, gates, top-k, budgets and running curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_row_number, running_sums


def ranks(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """df with competition rank, average rank and row number from high to low score in each group; null scores get null."""
    w = Window.partitionBy(*by, F.col(score).isNull()).orderBy(F.desc(score))
    has = F.col(score).isNotNull()
    rank = F.rank().over(w)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return df.withColumns({
        "rank": F.when(has, rank), "average_rank": F.when(has, rank + (tied - 1) / 2.0), "row_rank": F.when(has, F.row_number().over(Window.partitionBy(*by, F.col(score).isNull()).orderBy(F.desc(score), key))),
    })


def minmax(score: str, by: list[str], constant: float) -> Column:
    """Min-max of a score in its group; `constant` where the group has one value."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(F.col(score).isNotNull(), F.when(high == low, F.lit(float(constant))).otherwise((F.col(score) - low) / (high - low)))


def scaled(df: DataFrame, columns: list[str], *, constant: float = 0.5) -> DataFrame:
    """Global min-max of columns: statistics by one aggregate, broadcast as one row."""
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(hi == lo, F.lit(float(constant))).otherwise((F.col(c) - lo) / (hi - lo))))
    return out.select(*df.columns)


def zscored(df: DataFrame, columns: list[str], *, suffix: str = "_z", train: Column | None = None) -> DataFrame:
    """Global z-scores with the population deviation; 0 where it is 0. Statistics may come from training rows only."""
    base = df.where(train) if train is not None else df
    stats = base.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        mu, sd = F.col(f"{c}__mu"), F.col(f"{c}__sd")
        out = out.withColumn(f"{c}{suffix}", F.when(F.col(c).isNotNull(), F.when(sd > 1e-12, (F.col(c) - mu) / sd).otherwise(F.lit(0.0))))
    return out.drop(*[f"{c}__{n}" for c in columns for n in ("mu", "sd")])


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each group the value at place n // 2 of the ascending order (no interpolation)."""
    w = Window.partitionBy(*by).orderBy(value)
    rows = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"))
    return rows.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select(*by, F.col(value).alias("upper_median"))


def gated(df: DataFrame, by: list[str], gate: str, score: str, *, factor: float = 0.02) -> DataFrame:
    """df with `gated`: the score, times `factor` where the gate value lies below its group's upper median."""
    out = df.join(upper_median(df, by, gate), by, "left")
    return out.withColumn("gated", F.when(F.col(gate) < F.col("upper_median"), F.col(score) * factor).otherwise(F.col(score))).drop("upper_median")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; the plan keeps k rows a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("top_rank", F.row_number().over(w)).where(F.col("top_rank") <= k)


def hit_at(df: DataFrame, by: list[str], order: list[Column], flag: Column, ks: list[int]) -> DataFrame:
    """Share of groups with a flagged row that have one among their first k, for each k: (k, groups, hits, rate)."""
    w = Window.partitionBy(*by).orderBy(*order)
    best = df.select(*by, flag.alias("f_"), F.row_number().over(w).alias("r_")).where("f_").groupBy(*by).agg(F.min("r_").alias("first"))
    rows = best.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("first") <= k).alias("hit")) for k in ks])).alias("x"))
    return rows.groupBy("x.k").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("x.hit")).alias("hits")).withColumn("rate", F.col("hits") / F.col("groups"))


def mean_rank(df: DataFrame, by: list[str], order: list[Column], flag: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(flag.alias("f_"), F.row_number().over(w).alias("r_")).where("f_").agg(F.avg("r_").alias("mean_rank"))


def budget(df: DataFrame, score: str, key: str, positive: Column, fraction: float) -> DataFrame:
    """What the best-scored fraction of rows holds: k, positives in it, precision, recall, F1. k rounds half to even, 1 at least."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(key).alias("k_"), positive.cast("int").alias("p"))
    ranked = global_row_number(rows, [F.desc("s"), F.asc("k_")], "r")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("all"))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("long"))
    inside = ranked.join(F.broadcast(total)).where(F.col("r") <= k).groupBy("n", "all").agg(F.count(F.lit(1)).alias("k"), F.sum("p").alias("hits"))
    p, r = F.col("hits") / F.col("k"), F.try_divide("hits", "all")
    return inside.select("k", "hits", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def average_precision(df: DataFrame, score: str, key: str, label: str) -> DataFrame:
    """Area under the precision-recall curve as the sum of precision at each positive; ties by key."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    ranked = running_sums(rows, [F.desc("s"), F.asc("k")], {"r": F.lit(1), "tp": F.col("y")})
    return ranked.where("y = 1").agg(F.avg(F.col("tp") / F.col("r")).alias("auprc"))


def risk_coverage(df: DataFrame, risk: str, key: str, wrong: Column, coverages: list[float]) -> DataFrame:
    """(coverage, rows, risk): error rate among the least risky share of rows, for each share."""
    rows = df.where(F.col(risk).isNotNull()).select(F.col(risk).alias("s"), F.col(key).alias("k"), wrong.cast("int").alias("w"))
    ranked = global_row_number(rows, [F.asc("s"), F.asc("k")], "r").join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    cut = F.array(*[F.struct(F.lit(c).alias("coverage"), F.greatest(F.lit(1), F.bround(F.col("n") * c).cast("long")).alias("m")) for c in coverages])
    inside = ranked.select("r", "w", F.inline(cut)).where(F.col("r") <= F.col("m"))
    return inside.groupBy("coverage").agg(F.count(F.lit(1)).alias("rows"), F.avg("w").alias("risk"))


def discrete_aurc(curve: DataFrame, at: float = 0.8) -> DataFrame:
    """One row over the points of risk_coverage: `aurc`, the mean risk of the points, and `risk_at`, the risk at one coverage (null where it
    is no point of the curve)."""
    return curve.agg(F.avg("risk").alias("aurc"), F.max(F.when(F.col("coverage") == at, F.col("risk"))).alias("risk_at"))


def concordance(df: DataFrame, by: list[str], score: str, target: str) -> DataFrame:
    """For each group: pairs of rows whose targets differ, and the share in which the higher target scores higher (ties half).

    For targets of few values (labels, buckets): pairs of values are joined by their sorted scores' ranks, never rows with rows."""
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(score).alias("s"), F.col(target).alias("t"))
    # each pair of levels is a small two-class problem; levels are few, so their pairs are broadcast
    levels = rows.select(*by, F.col("t").alias("level")).distinct()
    low = levels.select(*[F.col(b).alias(f"b{i}_") for i, b in enumerate(by)], F.col("level").alias("lo"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"b{i}_"))
    pairs = levels.withColumnRenamed("level", "hi").join(low, same & (F.col("lo") < F.col("hi"))).select(*[f"b{i}_" for i in range(len(by))], "lo", "hi")
    met = rows.join(F.broadcast(pairs), same & ((F.col("t") == F.col("lo")) | (F.col("t") == F.col("hi"))))
    w = Window.partitionBy(*by, "lo", "hi").orderBy("s")
    rank = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "lo", "hi", "s")) - 1) / 2.0
    up = (F.col("t") == F.col("hi")).cast("int")
    each = met.withColumn("r", rank).groupBy(*by, "lo", "hi").agg(F.sum(up).alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(up == 1, F.col("r"))).alias("sr"))
    won = F.col("sr") - F.col("p") * (F.col("p") + 1) / 2.0
    return each.groupBy(*by).agg(F.sum(F.col("p") * (F.col("n") - F.col("p"))).alias("pairs"), (F.sum(won) / F.sum(F.col("p") * (F.col("n") - F.col("p")))).alias("concordance"))
