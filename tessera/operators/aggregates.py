"""Summaries: histograms, votes, rates over grouping sets, confusion and calibration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, rows) of several columns in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def shares(df: DataFrame, column: str, *, top: int | None = None) -> DataFrame:
    """(value, rows, share), most frequent first, ties by value; `top` keeps the first ones."""
    counts = histogram(df, column)
    total = counts.agg(F.sum("rows").alias("total"))
    out = counts.join(F.broadcast(total)).select("value", "rows", (F.col("rows") / F.col("total")).alias("share")).orderBy(F.desc("rows"), "value")
    return out.limit(top) if top else out


def distribution(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean and exact median of a value."""
    v = value.cast("double")
    aggs = [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median")]
    return df.groupBy(*(by or [])).agg(*aggs)


def array_summary(df: DataFrame, array: Column) -> DataFrame:
    """rows, items, mean, min, max and number of empty arrays."""
    n = F.coalesce(F.size(array), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("items"), F.avg(n).alias("mean_items"), F.min(n).alias("min_items"), F.max(n).alias("max_items"), F.count_if(n == 0).alias("empty_rows"))


def consistency(df: DataFrame, by: list[str], value: str, order: Column | None = None) -> DataFrame:
    """For each group the most frequent filled value, its count, the number of values and the share of the most frequent.
    Ties go to the value seen first in `order`, else to the smallest."""
    rows = df.where(F.length(F.trim(F.col(value).cast("string"))) > 0)
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"), (F.min(order) if order is not None else F.min(value)).alias("f"))
    return counts.groupBy(*by).agg(F.sum("c").alias("values"), F.min_by(value, F.struct((-F.col("c")).alias("a"), F.col("f").alias("b"), F.col(value).alias("v"))).alias("mode"), F.max("c").alias("mode_rows")).withColumn("consistency", F.col("mode_rows") / F.col("values"))


def label_votes(df: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    """For each group: votes for each allowed label as a map, the majority (ties by the order of labels), parsed and failed rows."""
    counts = [F.count_if(F.col(label) == x).alias(f"v{i}") for i, x in enumerate(labels)]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), *counts)
    parsed = sum((F.col(f"v{i}") for i in range(1, len(labels))), F.col("v0"))
    best = F.greatest(*[F.struct(F.col(f"v{i}").alias("c"), F.lit(-i).alias("o"), F.lit(x).alias("l")) for i, x in enumerate(labels)])
    return out.select(
        *by, "samples", parsed.alias("parsed"), (F.col("samples") - parsed).alias("failed"), F.create_map(*[y for i, x in enumerate(labels) for y in (F.lit(x), F.col(f"v{i}"))]).alias("votes"),
        F.when(parsed > 0, best["l"]).alias("majority"),
    )


def rate(condition: Column, base: Column | None = None) -> Column:
    """Share of rows (of the base) for which a condition holds; null without rows."""
    base = F.lit(True) if base is None else base
    return F.try_divide(F.count_if(condition & base), F.count_if(base))


def rates(df: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Rates of conditions over several grains at once (grouping sets): the columns of all sets, rows, and each rate."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grain = F.grouping_id().alias("grain")
    aggs = [F.count(F.lit(1)).alias("rows"), *[rate(c).alias(n) for n, c in measures.items()]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(grain, *aggs).drop("grain")


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(gold).cast("string").alias("gold"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))


def class_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) for every label of either column; 0 where a base is empty."""
    pairs = confusion(df, gold, predicted)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("gold").alias("label"), F.col("rows").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col("gold") == F.col("predicted"), F.col("rows")).otherwise(0).cast("long").alias("h")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("g"), F.col("rows").alias("p"), F.lit(0).cast("long").alias("h")))))
    out = sides.where("label is not null").groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return out.select("*", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def overall_metrics(df: DataFrame, gold: str, predicted: str, *, supported_only: bool = False) -> DataFrame:
    """One row: rows, accuracy, macro and weighted F1, balanced accuracy, the majority label's share."""
    by = class_metrics(df, gold, predicted)
    by = by.where("support > 0") if supported_only else by
    return by.agg(
        F.sum("support").alias("rows"), F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.try_divide(F.max("support"), F.sum("support")).alias("majority_share"),
    )


def equal_parts(df: DataFrame, score: str, key: str, parts: int) -> DataFrame:
    """df with `part`: 1 to `parts`, in which the first rows by score (high to low, ties by key) come first and the
    first parts have the rows left over. One global order is needed: ranks come from range partitions, not one task."""
    from .ordering import global_row_number

    ranked = global_row_number(df, [F.desc(score), F.asc(key)], "rn_")
    n = ranked.agg(F.count(F.lit(1)).alias("n_"))
    base = F.floor(F.col("n_") / parts).cast("long")
    extra = F.col("n_") % parts
    at = F.col("rn_") - 1
    part = F.when(at < extra * (base + 1), F.floor(at / (base + 1))).otherwise(extra + F.floor(F.try_divide(at - extra * (base + 1), base)))
    return ranked.join(F.broadcast(n)).withColumn("part", (part + 1).cast("int")).drop("rn_", "n_")


def calibration(df: DataFrame, score: str, label: str, key: str, parts: int = 5) -> DataFrame:
    """(part, rows, mean_score, rate, gap) of equal parts from high to low score."""
    out = equal_parts(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, key, parts)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_error(parts: DataFrame) -> DataFrame:
    return parts.agg(F.try_divide(F.sum(F.col("rows") * F.col("gap")), F.sum("rows")).alias("ece"))


def dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of a column that go with more than one value of another: (value, dependents)."""
    return df.groupBy(F.col(determinant).alias("value")).agg(F.count_distinct(dependent).alias("dependents")).where("dependents > 1")


def band_separation(df: DataFrame, band: str, value: str) -> DataFrame:
    """(band, low, high, next_low, separated): whether each band ends before the next begins. One row per band."""
    ends = df.groupBy(band).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    after = F.lead("low").over(Window.orderBy(band))
    return ends.withColumn("next_low", after).withColumn("separated", F.col("next_low").isNull() | (F.col("high") <= F.col("next_low")))


def group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def position_bias(df: DataFrame, position: str, limit: float = 0.40) -> DataFrame:
    """Share of each answer position, and whether one is above the limit."""
    return shares(df, position).withColumn("severe", F.col("share") > limit)


def majority_baseline(df: DataFrame, label: str, limit: float = 0.40) -> DataFrame:
    """One row: the label said most often (the first of equals), its share, which is the accuracy of saying nothing else, and whether it is above the limit."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max("n").alias("n"), F.sum("n").alias("rows"))
    first = counts.join(F.broadcast(best.select("n")), "n", "left_semi").agg(F.min("label").alias("label"))
    return first.join(F.broadcast(best)).select("label", "rows", (F.col("n") / F.col("rows")).alias("share"), (F.col("n") / F.col("rows") > limit).alias("severe"))


def fixed_letters(df: DataFrame, choices: str) -> DataFrame:
    """(text, times, letters, fixed) of the texts of choices, an array of structs with label and choice: how often a text is offered, under how many
    letters, and whether a text that is offered twice or more always stands under one."""
    rows = df.select(F.explode(choices).alias("c")).groupBy(F.col("c.choice").alias("text"), F.col("c.label").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy("text").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("letters"))
    return out.withColumn("fixed", (F.col("times") >= 2) & (F.col("letters") == 1))


def off_class_share(df: DataFrame, by: list[str], score: str, off: Column) -> DataFrame:
    """Share of the positive score mass that lies on rows of a class."""
    mass = F.greatest(F.col(score), F.lit(0.0))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(off, mass).otherwise(0.0)), F.sum(mass)).alias("off_share"))
