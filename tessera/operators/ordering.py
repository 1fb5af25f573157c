"""One order over a whole table without one task: row numbers and running sums from range partitions.

The range partition is made once and stored. Two uses of an unstored one would sample their own bounds, and adaptive
execution would merge their partitions each in its own way, so counts of one would not fit the rows of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

#: monotonically_increasing_id counts the rows of a partition in so many low bits.
ROW_BITS = 33


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt to ranges of the order, sorted and stored, with `pid_` (number of the range) and `ln_` (place in it, from 0)."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    held = stored(spread, "ranges")
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("id_", ROW_BITS).alias("pid_"), F.col("id_").bitwiseAND((1 << ROW_BITS) - 1).alias("ln_"))


def _shifted(held: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(pid_, one column per name): the sums over all ranges before. One row for each range."""
    parts = held.groupBy("pid_").agg(*[F.sum(c).alias(f"{n}_p") for n, c in sums.items()])
    before = Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("pid_", *[F.coalesce(F.sum(f"{n}_p").over(before), F.lit(0)).alias(f"{n}_b") for n in sums])


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a row number over the whole table, from 1 on without a gap.

    `order` must name rows uniquely, or tied rows get their numbers in any order. The rows of each range, one number a
    range, are counted in the stored table and broadcast. An empty table stays empty."""
    held = ranged(df, order)
    before = _shifted(held, {"n": F.lit(1)})
    return held.join(F.broadcast(before), "pid_").withColumn(name, F.col("ln_") + F.col("n_b") + 1).drop("pid_", "ln_", "n_b")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with one running sum for each name: over all rows up to and including this one in the order of the whole table.

    Null values add nothing. Rows that tie in the order stand in any order among themselves."""
    held = ranged(df, order)
    inside = Window.partitionBy("pid_").orderBy("ln_").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({f"{n}_l": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = local.join(F.broadcast(_shifted(held, sums)), "pid_").withColumns({n: F.col(f"{n}_l") + F.col(f"{n}_b") for n in sums})
    return out.drop("pid_", "ln_", *[f"{n}_{x}" for n in sums for x in "lb"])


def group_row_number(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with a row number in each group, from 1 on, however large a group is: groups are numbered in range partitions, and the rows of
    a group in the ranges before are added. Null is a group. `order` must name the rows of a group uniquely, or ties get their
    numbers in any order."""
    held = ranged(df, [*[F.asc_nulls_first(F.col(b)) for b in by], *order])
    parts = held.groupBy(*[F.col(b).alias(f"{b}_g") for b in by], F.col("pid_").alias("part_")).agg(F.count(F.lit(1)).alias("c_"), F.min("ln_").alias("first_"))
    before = F.sum("c_").over(Window.partitionBy(*[f"{b}_g" for b in by]).orderBy("part_")) - F.col("c_")
    same = F.col("pid_") == F.col("part_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_g"))
    out = held.join(parts.withColumn("b_", before), same)
    return out.withColumn(name, F.col("ln_") - F.col("first_") + F.col("b_") + 1).drop("pid_", "ln_", "part_", "c_", "first_", "b_", *[f"{b}_g" for b in by])
