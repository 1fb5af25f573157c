"""Joins with stated expectations, differences of versions, and pairs inside a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import ContractError, require_unique


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that one side lacks: the key columns and side (`left` has it alone, or `right`)."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def strict_join(left: DataFrame, right: DataFrame, on: list[str], *, one_to_one: bool = False) -> DataFrame:
    """Inner join in which the right side has each key once and both sides have the same keys; else an error names a key."""
    require_unique(right, on)
    if one_to_one:
        require_unique(left, on)
    first = unmatched(left, right, on).limit(1).collect()
    if first:
        raise ContractError(f"key {tuple(first[0][k] for k in on)} is only on the {first[0]['side']}")
    return left.join(right, on)


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    return unmatched(left, right, on).isEmpty()


def kept(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def missing(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(keys.select(*on), on, "left_anti")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r_"))
    return best.select(*keys, *[F.col("r_")[c].alias(c) for c in rest])


def filled_from(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left join that fills columns only where df has none; the other table has each key once."""
    side = other.select(*on, *[F.col(c).alias(f"{c}__other") for c in columns])
    out = df.join(side, on, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"{c}__other")) if c in df.columns else F.col(f"{c}__other"))
    return out.drop(*[f"{c}__other" for c in columns])


def transitions(old: DataFrame, new: DataFrame, on: list[str], value: str) -> DataFrame:
    """(transition, rows): how often each `old -> new` pair of values occurs over common keys."""
    pair = old.select(*on, F.col(value).cast("string").alias("a")).join(new.select(*on, F.col(value).cast("string").alias("b")), on)
    return pair.groupBy(F.concat_ws(" -> ", F.coalesce("a", F.lit("null")), F.coalesce("b", F.lit("null"))).alias("transition")).agg(F.count(F.lit(1)).alias("rows"))


def version_diff(old: DataFrame, new: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """One row per key of either side: status (added, removed, changed, same) and the columns that changed."""
    a = old.select(*on, F.struct(*values).alias("a"))
    b = new.select(*on, F.struct(*values).alias("b"))
    both = a.join(b, on, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col("a")[v].eqNullSafe(F.col("b")[v]), F.lit(v)) for v in values]))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(*on, status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("changed"), "a", "b")


def paired(df: DataFrame, on: list[str], role: str, treatment, control, value: str, order: str | None = None) -> DataFrame:
    """Treatment less control for each key that has both. Of several rows of a role the last by `order` counts (of equal
    ones the largest value), and a key drops out when that row has no value; without an order the largest value counts."""

    def of(which) -> Column:
        if order is None:
            return F.max(F.when(F.col(role) == which, F.col(value)))
        return F.max_by(F.col(value), F.when(F.col(role) == which, F.struct(order, value)))

    pivot = df.groupBy(*on).agg(of(treatment).alias("treatment"), of(control).alias("control"))
    return pivot.where("treatment is not null and control is not null").withColumn("delta", F.col("treatment") - F.col("control"))


def win_rate(df: DataFrame, group: list[str], positive: Column, score: str) -> DataFrame:
    """For each group: pairs of a positive and a negative row, and the share in which the positive scores higher (ties half).

    By ranks: no pair is made, so a hot group costs a sort, not its square."""
    rows = df.where(F.col(score).isNotNull()).withColumn("p_", positive.cast("int"))
    by = Window.partitionBy(*group).orderBy(score)
    rank = F.rank().over(by) + (F.count(F.lit(1)).over(Window.partitionBy(*group, score)) - 1) / 2.0
    ranked = rows.withColumn("r_", rank)
    out = ranked.groupBy(*group).agg(F.sum("p_").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p_") == 1, F.col("r_"))).alias("s"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return out.select(*group, pairs.alias("pairs"), F.when(pairs > 0, (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / pairs).alias("win_rate"))


def first_pairs(df: DataFrame, on: list[str], role: str, left, right, order: str) -> DataFrame:
    """The first row of either role for each key that has both."""
    out = df.groupBy(*on).agg(F.min(F.when(F.col(role) == left, F.col(order))).alias("first_left"), F.min(F.when(F.col(role) == right, F.col(order))).alias("first_right"))
    return out.where("first_left is not null and first_right is not null")


def overlaps(left: DataFrame, right: DataFrame, on: list[str], *, width: int) -> DataFrame:
    """Pairs of intervals [start, end) with the same key that overlap.

    Intervals are dealt to bins of `width` and joined on key and bin, so neither a key nor a long time axis
    makes a product; a pair is taken in the bin where the later of the two starts. Both sides have columns
    start and end; those of the right come out as r_start and r_end. Empty intervals overlap nothing."""

    def binned(df: DataFrame) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where(F.col("end") > F.col("start")).withColumn("bin_", F.explode(bins))

    other = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    other = other.where("r_end > r_start").withColumn("bin_", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor((F.col("r_end") - 1) / width))))
    met = binned(left).join(other, [*on, "bin_"]).where((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")))
    return met.where(F.col("bin_") == F.floor(F.greatest("start", "r_start") / width)).drop("bin_")


def membership(mentions: DataFrame, prompts: DataFrame, ontology: DataFrame, key: list[str], prompt_key: list[str]) -> DataFrame:
    """mentions with label: echoed when the prompt has the id, grounded when the ontology has it, else fabricated."""
    said = prompts.select(*prompt_key, *key).distinct().withColumn("said_", F.lit(True))
    known = ontology.select(*key).distinct().withColumn("known_", F.lit(True))
    out = mentions.join(said, [*prompt_key, *key], "left").join(known, key, "left")
    return out.withColumn("label", F.when(F.col("said_"), "echoed").when(F.col("known_"), "grounded").otherwise("fabricated")).drop("said_", "known_")
