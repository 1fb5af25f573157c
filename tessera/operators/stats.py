"""Statistics of scores: AUROC, rank correlation, grouped bootstrap, leave-one-out means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .ordering import running_sums


def counted_below(values: DataFrame, order: str, count: str, name: str, by: list[str]) -> DataFrame:
    """values with the sum of `count` over the rows of the group that come before in order, 0 for the first. Without groups the
    values are dealt to ranges of the order: no task sees the whole table."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return values.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)))
    return running_sums(values, [F.asc(order)], {name: F.col(count)}).withColumn(name, F.col(name) - F.col(count))


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Tie-aware AUROC for each group: positives, negatives, auroc (null with one class).

    Scores are counted by value first: ranks are cumulative counts over distinct values, and a window only sees those."""
    by = by or []
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = rows.groupBy(*by, F.col(score).alias("s_")).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = counted_below(values, "s_", "n", "below_", by).withColumn("r", F.col("below_") + (F.col("n") + 1) / 2.0)
    out = ranked.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.sum(F.col("p") * F.col("r")).alias("sr"))
    p, q = F.col("positives"), F.col("negatives")
    return out.select(*by, "positives", "negatives", F.when((p > 0) & (q > 0), (F.col("sr") - p * (p + 1) / 2.0) / (p * q)).alias("auroc"))


def average_ranks(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the average rank of a column in its group (1 for the smallest), by counting values, then joining back."""
    by = by or []
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n_"))
    ranked = counted_below(values, column, "n_", "below_", by).withColumn(name, F.col("below_") + (F.col("n_") + 1) / 2.0).drop("n_", "below_")
    # merged, since there may be as many distinct values as rows: a broadcast table of them would go through the driver
    return df.join(ranked.hint("merge"), [*by, column], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns in each group: rows and spearman (null when one is constant)."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(rows, x, "rx_", by), y, "ry_", by)
    moving = (F.var_pop("rx_") > 0) & (F.var_pop("ry_") > 0)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.when(moving, F.corr("rx_", "ry_")).alias("spearman"))


def multiplicity(group: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a replicate of the bootstrap draws a group: a Poisson(1) variate from integer arithmetic on sha256.

    A group's draws depend on seed, replicate and group alone, so replicates need no shuffle of rows, and another engine
    gets the same."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), group.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    # Cumulative Poisson(1) probabilities in units of 2**-32
    ends = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923275]
    out = F.lit(len(ends))
    for k in range(len(ends) - 1, -1, -1):
        out = F.when(u < ends[k], k).otherwise(out)
    return out


def replicates(df: DataFrame, group: str, rounds: int, seed: int = 0) -> DataFrame:
    """df once for each round in which its group is drawn, with `round` and `times`."""
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return rows.withColumn("times", multiplicity(F.col(group), F.col("round"), seed)).where("times > 0")


def interval(values: DataFrame, column: str, level: float = 0.95, *, method: str = "linear") -> DataFrame:
    """(rounds, mean, low, high) of bootstrap values: by interpolation, or by order statistics floor(q * (B - 1)) or floor(q * B)."""
    tail = (1 - level) / 2
    if method == "linear":
        ends = [F.percentile(column, F.lit(q)) for q in (tail, 1 - tail)]
    else:
        order = F.array_sort(F.collect_list(column))  # one value a round
        less = 1 if method == "rank" else 0
        ends = [F.element_at(order, F.least(F.floor(F.lit(q) * (F.size(order) - less)).cast("int") + 1, F.size(order))) for q in (tail, 1 - tail)]
    return values.agg(F.count(column).alias("rounds"), F.avg(column).alias("mean"), ends[0].alias("low"), ends[1].alias("high"))


def bootstrap_mean(df: DataFrame, group: str, value: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """(round, mean) of the value over drawn groups. Groups are summed first, so a round moves one row per group."""
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    drawn = replicates(sums, group, rounds, seed)
    return drawn.groupBy("round").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))


def bootstrap_auroc(df: DataFrame, group: str, label: str, scores: list[str], rounds: int = 200, seed: int = 0) -> DataFrame:
    """(round, one AUROC per score) over drawn groups; rounds with one class give null."""
    pairs = F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("s_")) for s in scores])
    rows = df.select(group, F.col(label).cast("int").alias("y_"), F.inline(pairs)).where("s_ is not null and y_ is not null")
    cells = rows.groupBy(group, "name", "s_").agg(F.sum("y_").alias("p"), F.count(F.lit(1)).alias("n"))
    drawn = replicates(cells, group, rounds, seed).groupBy("round", "name", "s_").agg(F.sum(F.col("p") * F.col("times")).alias("p"), F.sum(F.col("n") * F.col("times")).alias("n"))
    # all rounds are put in one order of range partitions, so that none is ranked in one task
    upto = stored(running_sums(drawn, [F.asc("round"), F.asc("name"), F.asc("s_")], {"upto": F.col("n")}), "rounds")
    start = upto.groupBy("round", "name").agg(F.min(F.col("upto") - F.col("n")).alias("start"))  # a row for each round and score
    below = F.col("upto") - F.col("n") - F.col("start")
    sums = upto.join(F.broadcast(start), ["round", "name"]).withColumn("r", below + (F.col("n") + 1) / 2.0).groupBy("round", "name").agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), F.sum(F.col("p") * F.col("r")).alias("sr"))
    p, q = F.col("p"), F.col("q")
    each = sums.withColumn("a", F.when((p > 0) & (q > 0), (F.col("sr") - p * (p + 1) / 2.0) / (p * q)))
    return each.groupBy("round").agg(*[F.max(F.when(F.col("name") == s, F.col("a"))).alias(s) for s in scores])


def paired_bootstrap(df: DataFrame, group: str, label: str, base: str, other: str, rounds: int = 200, seed: int = 0, least_valid: float = 0.8) -> DataFrame:
    """One row: rounds, mean, low, high of other's AUROC less base's, and the verdict; null ends when too few rounds have both classes."""
    from ..functions.rules import verdict

    deltas = bootstrap_auroc(df, group, label, [base, other], rounds, seed).select((F.col(other) - F.col(base)).alias("d"))
    out = interval(deltas, "d")
    enough = F.col("rounds") >= least_valid * rounds
    return out.select("rounds", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high")).withColumn("verdict", verdict(F.col("low"), F.col("high")))


def independent_difference(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """Interval of the difference of two bootstraps, joined by round."""
    a, b = one.select("round", F.col(column).alias("a")), two.select("round", F.col(column).alias("b"))
    return interval(a.join(b, "round").select((F.col("a") - F.col("b")).alias("d")), "d")


def loo_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with loo_mean: the mean of the other rows of the group, null for a row alone."""
    keys = [F.col(c).alias(f"k{i}_") for i, c in enumerate(by)]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("s_"), F.count(value).alias("n_"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"k{i}_"))
    out = df.join(sums, same)
    return out.select(*df.columns, F.when(F.col("n_") > 1, (F.col("s_") - F.col(value)) / (F.col("n_") - 1)).alias("loo_mean"))


def usefulness(df: DataFrame, features: str, target: str) -> DataFrame:
    """(feature, rows, spearman) of every key of a map column with the target."""
    long = df.select(F.col(target).alias("t"), F.explode(features).alias("feature", "v"))
    return spearman(long, "v", "t", ["feature"])


def hash_uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def calibrated_temperature(df: DataFrame, logits: str, target: str, grid: list[float]) -> DataFrame:
    """The temperature of the grid under which the expected class correlates best with the target: (temperature, spearman)."""
    from ..functions.vectors import expected, softmax

    parts = [df.select(F.lit(float(t)).alias("temperature"), F.round(expected(softmax(F.col(logits), t)), 12).alias("e"), F.col(target).alias("t")) for t in grid]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return spearman(rows, "e", "t", ["temperature"]).orderBy(F.desc_nulls_last("spearman"), "temperature").limit(1).select("temperature", "spearman")
