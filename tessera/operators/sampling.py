"""Repeatable samples, quotas and splits by hash order; budgets of whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_row_number


def order_of(key: str | Column, seed: int = 0) -> Column:
    """A random order that depends on seed and key alone: sha256 of `seed:key`. The same in any engine."""
    c = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"), 256)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement; every task keeps n at most before they meet."""
    return df.orderBy(order_of(key, seed), key).limit(n)


def quota(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in hash order."""
    w = Window.partitionBy(*by).orderBy(order_of(key, seed), key)
    return df.withColumn("q_", F.row_number().over(w)).where(F.col("q_") <= n).drop("q_")


def short_quotas(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Groups with fewer rows than a quota asks for."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < n)


def quota_then_fill(df: DataFrame, by: list[str], key: str, n: int, total: int, seed: int = 0) -> DataFrame:
    """A quota of each group, filled up to `total` rows with others in hash order."""
    first = quota(df, by, key, n, seed)
    rest = df.join(first.select(key), key, "left_anti")
    both = first.withColumn("o_", F.lit(0)).unionByName(rest.withColumn("o_", F.lit(1)))
    return both.orderBy("o_", order_of(key, seed), key).limit(total).drop("o_")


def shuffled_choices(choices: Column, key: Column, seed: int = 0) -> Column:
    """An array of choices in an order that depends on seed, key and place, with labels A, B, C and on:
    array<struct<label, choice, original_position>>."""
    keyed = F.transform(choices, lambda c, i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")).cast("binary"), 256).alias("h"), c.alias("choice"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda k, j: F.struct(F.chr(j + 65).alias("label"), k["choice"].alias("choice"), k["i"].cast("int").alias("original_position")))


def group_split(df: DataFrame, group: str, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """df with `split`: whole groups in hash order, cut at the floors of the ratios; the last split takes the rest."""
    groups = df.select(group).distinct()
    ranked = global_row_number(groups, [order_of(group, seed).asc(), F.asc(group)], "r_").join(F.broadcast(groups.agg(F.count(F.lit(1)).alias("n_"))))
    names = list(ratios)
    cut, out = F.lit(0).cast("long"), F.lit(names[-1])
    cuts = []
    for name in names[:-1]:
        cut = cut + F.floor(F.col("n_") * ratios[name]).cast("long")
        cuts.append((name, cut))
    for name, end in reversed(cuts):
        out = F.when(F.col("r_") <= end, name).otherwise(out)
    return df.join(ranked.select(group, out.alias("split")), group)


def folds(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold` 0 to k - 1: whole groups, dealt in hash order, so fold sizes in groups differ by one at most."""
    groups = df.select(group).distinct()
    ranked = global_row_number(groups, [order_of(group, seed).asc(), F.asc(group)], "r_")
    return df.join(ranked.select(group, ((F.col("r_") - 1) % k).cast("int").alias("fold")), group)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold`: rows of each label dealt in hash order."""
    w = Window.partitionBy(label).orderBy(order_of(key, seed), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def fold_ladder(smallest: int) -> int:
    """How many folds the smallest class allows: 5, 3, 2, or 0 for leave-one-out."""
    return next((k for k in (5, 3, 2) if smallest >= k), 0)


#: A run of groups with equal counts and where they go: the group with number start + i goes to fold order[i % len(order)].
Run = tuple[int, int, int, int, list[int]]


def dealt_profiles(profiles: list[tuple[int, int, int]], k: int) -> tuple[list[Run], list[tuple[int, int]]]:
    """Deal groups to k folds knowing only how many groups have so many positives and rows: (runs, positives and rows of each fold).

    One group after another, those with the most positives, then rows, first, each to the fold with the fewest positives, then rows; groups
    without a positive to the fold with the fewest rows. Groups with equal counts are alike, and once each fold got one of
    them in a round, all further rounds of them are the same, so they are dealt at once."""
    state, runs = [[0, 0] for _ in range(k)], []
    for p, n, groups in sorted(profiles, key=lambda x: (-x[0], -x[1])):
        at = 0
        while at < groups:
            order = []
            for _ in range(min(k, groups - at)):
                f = min(range(k), key=lambda i: (*(state[i] if p else state[i][::-1]), i))
                state[f][0] += p
                state[f][1] += n
                order.append(f)
            length = len(order)
            if len(set(order)) == k:
                more = (groups - at) // k - 1
                for f in range(k):
                    state[f][0] += more * p
                    state[f][1] += more * n
                length += more * k
            runs.append((p, n, at, length, order))
            at += length
    return runs, [(p, n) for p, n in state]


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold`: whole groups, balanced in positives and rows, both classes in every fold, else an error.

    Which fold a group goes to depends on its counts and its number among the groups of equal counts, which follows a hash of
    the group. The driver sees one row for each pair of counts there is; groups are numbered in range partitions. Rows of null group
    are left out."""
    from .ordering import ranged

    table = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(F.col(label).cast("int")).alias("p_"), F.count(F.lit(1)).alias("n_"))
    held = ranged(table.fillna(0, ["p_"]), [F.desc("p_"), F.desc("n_"), order_of(group, seed).asc(), F.asc(group)])
    parts = held.groupBy("p_", "n_", "pid_").agg(F.count(F.lit(1)).alias("c_"), F.min("ln_").alias("first_"))
    seen: dict[tuple[int, int], int] = {}
    shifts = []
    for r in parts.orderBy("pid_").collect():  # one row for each pair of counts and range that meet
        before = seen.get((r["p_"], r["n_"]), 0)
        shifts.append((r["p_"], r["n_"], r["pid_"], before - r["first_"]))
        seen[r["p_"], r["n_"]] = before + r["c_"]
    runs, state = dealt_profiles([(p, n, c) for (p, n), c in seen.items()], k)
    if not all(0 < p < n for p, n in state):
        raise ValueError(f"no deal of {sum(seen.values())} groups to {k} folds with both classes in each")
    spark = df.sparkSession
    shift = F.broadcast(spark.createDataFrame(shifts, "p_ long, n_ long, pid_ long, shift_ long"))
    run = F.broadcast(spark.createDataFrame(runs, "p_ long, n_ long, start_ long, length_ long, order_ array<int>"))
    numbered = held.join(shift, ["p_", "n_", "pid_"]).withColumn("at_", F.col("ln_") + F.col("shift_"))
    placed = numbered.join(run, ["p_", "n_"]).where((F.col("at_") >= F.col("start_")) & (F.col("at_") < F.col("start_") + F.col("length_")))
    fold = F.get("order_", ((F.col("at_") - F.col("start_")) % F.size("order_")).cast("int"))
    return df.join(placed.select(group, fold.alias("fold")), group)


def label_folds(df: DataFrame, label: str, key: str, wanted: int = 5, seed: int = 0) -> tuple[DataFrame, int]:
    """(df with `fold`, number of folds): rows of each label dealt to as many folds as wanted, but no more than the rarest label has rows;
    with fewer than two rows of some label, one fold for each row (leave one out). Rows of null label are left out.

    Rows of a label are numbered in range partitions of (label, hash of the key)."""
    from .ordering import group_row_number

    if wanted < 2:
        raise ValueError("two folds at least")
    rows = df.where(F.col(label).isNotNull())
    rarest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).collect()[0][0]
    if rarest is None:
        return rows.withColumn("fold", F.lit(0)), 0
    if rarest < 2:
        out = global_row_number(rows, [order_of(key, seed).asc(), F.asc(key)], "fold")
        return out.withColumn("fold", (F.col("fold") - 1).cast("int")), rows.count()
    k = min(wanted, rarest)
    out = group_row_number(rows, [label], [order_of(key, seed).asc(), F.asc(key)], "fold")
    return out.withColumn("fold", ((F.col("fold") - 1) % k).cast("int")), k


def whole_groups(df: DataFrame, group: str, rows: int, seed: int = 0) -> DataFrame:
    """Whole groups in hash order until exactly `rows` rows are taken, passing over groups that would overflow.

    Sequential over one row per group; stops as soon as the sample is full."""
    table = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rows).orderBy(order_of(group, seed), group)
    taken, left = [], rows
    for r in table.toLocalIterator():
        if r["n"] <= left:
            taken.append((r[group],))
            left -= r["n"]
        if not left:
            break
    if left:
        raise ValueError(f"groups do not add up to {rows} rows")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(taken, f"{group} {dict(df.dtypes)[group]}")), group, "left_semi")


def config_grid(spark, grids: list[dict[str, list]]) -> DataFrame:
    """The union of partial products of settings, each configuration once; what a grid leaves out is null."""
    import itertools

    names = list(dict.fromkeys(n for g in grids for n in g))
    seen = {tuple(str(dict(zip(g, values, strict=True)).get(n)) if n in g else None for n in names) for g in grids for values in itertools.product(*g.values())}
    return spark.createDataFrame(sorted(seen, key=str), ", ".join(f"{n} string" for n in names))
