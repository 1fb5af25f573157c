"""Hidden vectors and attention in long form: pooling at positions, mass in and out of a slot, distances between versions of an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def pooled(hidden: DataFrame, positions: DataFrame, key: str, width: int) -> DataFrame:
    """(key, positions, vector): mean of the vectors at the distinct positions asked for. hidden has key, position and vector of `width`
    numbers. A position that hidden lacks is an error of that key: `missing` counts them."""
    asked = positions.select(key, "position").distinct()
    met = asked.join(hidden.select(key, "position", "vector"), [key, "position"], "left")
    out = met.groupBy(key).agg(F.count("vector").alias("positions"), F.count_if(F.col("vector").isNull()).alias("missing"), *V.mean_vector(F.col("vector"), width))
    return out.select(key, "positions", "missing", F.array(*[f"m{i}" for i in range(width)]).alias("vector"))


def slot_statistics(attention: DataFrame, slots: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """For each group (such as case and layer): attention mass into, out of and within the slot positions, as shares of all mass; entropy of
    the mass that keys receive; share of the `top` keys. attention has by, q, k and w >= 0; slots has the first of `by` and position."""
    own = slots.select(by[0], F.col("position").alias("p_")).distinct()
    q = own.withColumnRenamed("p_", "q").withColumn("from_", F.lit(True))
    k = own.withColumnRenamed("p_", "k").withColumn("to_", F.lit(True))
    rows = attention.join(q, [by[0], "q"], "left").join(k, [by[0], "k"], "left")
    inside, out, into = F.col("from_").isNotNull() & F.col("to_").isNotNull(), F.col("from_").isNotNull() & F.col("to_").isNull(), F.col("from_").isNull() & F.col("to_").isNotNull()
    keys = rows.groupBy(*by, "k").agg(F.sum("w").alias("w"), *[F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in (("within", inside), ("out", out), ("into", into))])
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "k"))).withColumn("all", F.sum("w").over(Window.partitionBy(*by)))
    share = F.col("w") / F.col("all")
    plogp = F.when(share > 0, share * F.log(share)).otherwise(0.0)
    return ranked.where("all > 0").groupBy(*by).agg(*[(F.sum(n) / F.first("all")).alias(n) for n in ("within", "out", "into")], (-F.sum(plogp)).alias("entropy"), F.sum(F.when(F.col("r") <= top, share).otherwise(0.0)).alias("top_share"))


def versions(df: DataFrame, key: str, kind: str, vector: str) -> DataFrame:
    """(key, recovered_index, cosines and distances): the original and masked version of each case against each other and each recovered one."""
    one = lambda name: df.where(F.col(kind) == name).groupBy(key).agg(F.min_by(vector, "input_index").alias(f"{name}_"))
    rec = df.where(F.col(kind) == "recovered").select(key, F.col("input_index").alias("recovered_index"), F.col(vector).alias("recovered_"))
    both = one("original").join(one("masked"), key).join(rec, key)
    out = []
    for a, b in (("original", "masked"), ("original", "recovered"), ("masked", "recovered")):
        x, y = F.col(f"{a}_"), F.col(f"{b}_")
        out += [V.cosine(x, y).alias(f"{a}_{b}_cosine"), V.distance(x, y).alias(f"{a}_{b}_distance")]
    return both.select(key, "recovered_index", *out)


def pre_recovery(original: Column, masked: Column) -> Column:
    """struct of how masking moved a vector, before anything is recovered: relative and absolute distance, cosine, the change of length."""
    a, b = V.norm(original), V.norm(masked)
    d = V.distance(original, masked)
    return F.struct(d.alias("delta_norm"), F.when(a > 1e-12, d / a).alias("delta_relative_norm"), V.cosine(original, masked).alias("similarity"), (b - a).alias("norm_change"))
