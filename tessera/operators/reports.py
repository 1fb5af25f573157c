"""Summaries that a study's reports are made of: strata, harm, cells, paired conditions, recomputed values, checks, picks, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signals as G
from . import aggregates as A
from . import sampling as P
from . import stats as S


def strata(df: DataFrame, columns: list[str], score: str, label: str, least: int = 8) -> DataFrame:
    """(stratum, rows, positives, available, auroc) for every value of every column; strata of few rows or one class have no AUROC."""
    rows = df.select(F.col(score).alias("s"), F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in columns])).alias("stratum")).where("stratum is not null")
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))
    ok = (F.col("rows") >= least) & (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    out = counts.withColumn("available", ok).join(S.auroc(rows, "s", "y", ["stratum"]).select("stratum", "auroc"), "stratum", "left")
    return out.withColumn("auroc", F.when(F.col("available"), F.col("auroc")))


def harm_rates(df: DataFrame, by: list[str], top_changed: str, entropy_delta: str, margin_delta: str) -> DataFrame:
    """Rates of each kind of harm, and of any, for every configuration."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kinds = {"harm": G.harmed(F.col(top_changed), F.col(entropy_delta), F.col(margin_delta)), "top1": zero(top_changed) > 0, "entropy": zero(entropy_delta) > 1.0, "margin": zero(margin_delta) < -0.25}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[A.rate(c).alias(f"{n}_rate") for n, c in kinds.items()])


def cells(df: DataFrame, by: list[str], value: str, others: list[str], flag: Column | None = None) -> DataFrame:
    """Means of values, share of positive ones and rate of a flag, for every cell."""
    more = [A.rate(flag).alias("flag_rate")] if flag is not None else []
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias(f"mean_{value}"), *[F.avg(c).alias(f"mean_{c}") for c in others], F.avg((F.coalesce(F.col(value), F.lit(0.0)) > 0).cast("int")).alias("positive_rate"), *more)


def best_cell(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """The cell of the largest value, the first of equals."""
    return table.where(F.col(value).isNotNull()).orderBy(F.desc(value), *by).limit(1)


def paired_cells(df: DataFrame, on: list[str], cell: list[str], condition: str, order: str, value: str, treatment: str, control: str) -> DataFrame:
    """(cell, pairs, mean, stable): treatment less control for keys that have both, averaged by cell; of several rows of a key and condition the
    last in order counts. A cell is stable when its mean is above two standard errors."""
    last = lambda x: F.max_by(F.when(F.col(condition) == x, F.col(value)), F.when(F.col(condition) == x, F.col(order)))
    both = df.groupBy(*dict.fromkeys([*on, *cell])).agg(last(treatment).alias("t"), last(control).alias("c")).where("t is not null and c is not null").withColumn("d", F.col("t") - F.col("c"))
    out = both.groupBy(*cell).agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    return out.select(*cell, "pairs", "mean", F.coalesce(F.col("mean") > 2 * F.col("error"), F.lit(False)).alias("stable"))


def better_rate(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Share of rows whose left rank is smaller, where both are known."""
    return df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(left) < F.col(right)).cast("int")).alias("better_rate"))


def stability(df: DataFrame, key: list[str], setting: str, items: str) -> DataFrame:
    """(setting_a, setting_b, keys, overlap): mean overlap of the lists that two settings give for the same key. Settings are few."""
    a = df.select(*key, F.col(setting).alias("setting_a"), F.col(items).alias("x"))
    b = df.select(*key, F.col(setting).alias("setting_b"), F.col(items).alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.lit(1), F.least(F.size("x"), F.size("y")))
    return a.join(b, key).where("setting_a < setting_b").groupBy("setting_a", "setting_b").agg(F.count(F.lit(1)).alias("keys"), F.avg(share).alias("overlap"))


def condition_scores(df: DataFrame, by: list[str], example: str, failed: Column, degenerate: Column, correct: Column) -> DataFrame:
    """For each condition: traces, rates of failure, degeneration and correct answers, their score (the lower the better), and examples that
    have both outcomes."""
    each = df.groupBy(*by, example).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f"), F.count_if(degenerate).alias("d"), F.count_if(correct).alias("c"))
    total = lambda c: F.sum(c) / F.sum("n")
    out = each.groupBy(*by).agg(F.sum("n").alias("traces"), total("f").alias("failure_rate"), total("d").alias("degeneration_rate"), total("c").alias("correct_rate"), F.count_if((F.col("c") > 0) & (F.col("c") < F.col("n"))).alias("mixed_examples"))
    return out.withColumn("score", F.col("failure_rate") + F.col("degeneration_rate"))


def recomputed(old: DataFrame, new: DataFrame, on: list[str], features: list[str]) -> DataFrame:
    """(feature, rows, same_rate, spearman): values computed anew against those on record, over common keys; below three rows no correlation."""
    kept = lambda df, n: df.select(*on, *[F.col(f).cast("double").alias(f"{n}{i}_") for i, f in enumerate(features)])
    # merged, since both tables grow alike: a broadcast one would go through the driver
    met = kept(old, "a").join(kept(new, "b").hint("merge"), on)
    both = met.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}_").alias("a"), F.col(f"b{i}_").alias("b")) for i, f in enumerate(features)])))
    same = both.groupBy("feature").agg(F.count(F.lit(1)).alias("all"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")).alias("same_rate"))
    rho = S.spearman(both, "a", "b", ["feature"])
    return same.join(rho, "feature", "left").select("feature", F.col("all").alias("rows"), "same_rate", F.when(F.col("rows") >= 3, F.col("spearman")).alias("spearman"))


def checks(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row: each named aggregate condition, and whether all hold."""
    out = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in named.items()])
    return out.withColumn("all_hold", reduce(lambda a, b: a & b, [F.col(n) for n in named], F.lit(True)))


def recall_by(df: DataFrame, columns: list[str], gold: Column, predicted: Column) -> DataFrame:
    """(field, value, positives, found, recall): how many positives each value of each column holds, and how many were predicted."""
    rows = df.where(gold).select(predicted.alias("hit"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])))
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("positives"), F.count_if("hit").alias("found")).withColumn("recall", F.col("found") / F.col("positives"))


def counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(stage, field, value, rows) over several tables: their rows, and the histogram of each column named."""
    out = []
    for name, (df, columns) in tables.items():
        cells_ = F.array(F.struct(F.lit("rows").alias("field"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
        out.append(df.select(F.lit(name).alias("stage"), F.inline(cells_)))
    return reduce(DataFrame.unionByName, out).groupBy("stage", "field", "value").agg(F.count(F.lit(1)).alias("rows"))


def nested_samples(df: DataFrame, key: str, samples: str, label: str, score: str) -> DataFrame:
    """(label, records, samples, mean_score, best): over the sample structs that records hold as an array."""
    rows = df.select(F.col(key).alias("r_"), F.explode(samples).alias("s"))
    return rows.groupBy(F.col(f"s.{label}").alias("label")).agg(F.count_distinct("r_").alias("records"), F.count(F.lit(1)).alias("samples"), F.avg(f"s.{score}").alias("mean_score"), F.max(f"s.{score}").alias("best"))


def first_rows(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, for a report's examples."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r_") <= n).drop("r_")


def covering_picks(df: DataFrame, key: str, wants: dict[str, Column], per_want: int, total: int) -> DataFrame:
    """At most `total` rows: per_want of each want in turn, then others, each row once, under the first want that takes it. The bound makes
    every step a top-k."""
    taken, parts = None, []
    for i, (name, test) in enumerate([*wants.items(), ("other", F.lit(True))]):
        rows = df.where(F.coalesce(test, F.lit(False)))
        rows = rows if taken is None else rows.join(F.broadcast(taken), key, "left_anti")
        part = rows.orderBy(key).limit(per_want if name != "other" else total).withColumns({"want": F.lit(name), "o_": F.lit(i)})
        parts.append(part)
        taken = part.select(key) if taken is None else taken.unionByName(part.select(key))
    return reduce(DataFrame.unionByName, parts).orderBy("o_", key).limit(total).drop("o_")


def complete_cases(df: DataFrame, key: str, tables: list[DataFrame], n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order of those whose key every table has."""
    for table in tables:
        df = df.join(table.select(key), key, "left_semi")
    return P.sample(df, key, n, seed)


def profile(df: DataFrame, json: str) -> DataFrame:
    """(field, rows, filled, numbers, longest) of the keys of JSON objects of unknown form."""
    cells_ = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("field", "v"))
    return cells_.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim("v"), F.lit("")) != "").alias("filled"), F.count_if(F.col("v").rlike(r"^-?\d+(\.\d+)?$")).alias("numbers"), F.max(F.length("v")).alias("longest"))


def synthetic(spark: SparkSession, groups: int, per_group: int, rate: float, seed: int = 0) -> DataFrame:
    """(group_id, row, y, score, noise): grouped two-class rows for tests; score leans by half towards the label, noise doesn't."""
    rows = spark.range(groups * per_group).select((F.col("id") / per_group).cast("long").alias("group_id"), F.col("id").alias("row"))
    u = lambda k: S.hash_uniform(F.col("row"), seed + k)
    rows = rows.withColumn("y", (u(0) < rate).cast("int"))
    return rows.withColumns({"score": (u(1) + 0.5 * F.col("y")) / 1.5, "noise": u(2)})


def macro_f1_gain(df: DataFrame, key: str, gold: str, base: str, other: str, rounds: int = 50, seed: int = 0) -> DataFrame:
    """(round, gain): macro F1 of one prediction less another's over bootstrap draws of rows. Rows are counted by (round, labels) before they
    meet, so a round moves one row per cell of the confusion."""
    drawn = S.replicates(df.select(key, F.col(gold).alias("g"), F.col(base).alias("a"), F.col(other).alias("b")), key, rounds, seed)
    cell = drawn.groupBy("round", "g", "a", "b").agg(F.sum("times").alias("n"))
    one = lambda side, p: F.array(*[F.struct(F.lit(side).alias("side"), F.col(x).alias("label"), F.when(F.lit(x == "g"), F.col("n")).otherwise(0).alias("s"), F.when(F.lit(x != "g"), F.col("n")).otherwise(0).alias("p"), F.when(F.lit(x == "g") & (F.col("g") == F.col(p)), F.col("n")).otherwise(0).alias("h")) for x in ("g", p)])
    rows = cell.select("round", F.inline(F.concat(one("base", "a"), one("other", "b"))))
    by = rows.groupBy("round", "side", "label").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    f1 = F.when(F.col("s") + F.col("p") > 0, 2 * F.col("h") / (F.col("s") + F.col("p"))).otherwise(0.0)
    macro = by.groupBy("round", "side").agg(F.avg(f1).alias("f"))
    return macro.groupBy("round").agg((F.max(F.when(F.col("side") == "other", F.col("f"))) - F.max(F.when(F.col("side") == "base", F.col("f")))).alias("gain"))


def observability_gap(one: DataFrame, two: DataFrame, group: str, label: str, score: str, rounds: int = 50, seed: int = 0, backends: tuple[str, str] = ("same", "same")) -> DataFrame:
    """One row: lead of each arm's scores (2 A - 1, 0 at least), their difference, its interval over independent bootstraps, and the verdict.
    Arms of different backends aren't compared."""
    from ..functions.rules import verdict

    if backends[0] != backends[1]:
        raise ValueError(f"the arms come from different backends: {backends[0]} and {backends[1]}")
    point = lambda df, n: S.auroc(df, score, label).select(G.observability(F.col("auroc")).alias(n))
    boot = lambda df, s: S.bootstrap_auroc(df, group, label, [score], rounds, s).where(F.col(score).isNotNull()).select("round", G.observability(F.col(score)).alias("lead"))
    gap = S.independent_difference(boot(one, seed), boot(two, seed + 1), "lead")
    out = F.broadcast(point(one, "lead_one")).join(F.broadcast(point(two, "lead_two"))).join(F.broadcast(gap.select("rounds", "low", "high")))
    return out.withColumn("gap", F.col("lead_one") - F.col("lead_two")).withColumn("verdict", verdict(F.col("low"), F.col("high")))
