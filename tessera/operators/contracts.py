"""Record contracts: required and forbidden columns, named rules, uniqueness, leakage guards.

Column checks happen on the schema, before anything runs. Row rules are one projection; nothing is collected
but the first few offending rows when a caller asks for an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks its contract."""


# ---- on the schema


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def forbid(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    if present:
        raise ContractError(f"columns that may not be there: {', '.join(present)}")
    return df


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields, those inside structs, arrays and map values too."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *field_paths(f.dataType, path)]
        return out
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, f"{prefix}{{}}")
    return []


def no_leakage(df: DataFrame, names: Iterable[str], *, parts: bool = False) -> DataFrame:
    """No field anywhere in the schema may have one of the names (or, with parts, hold one of them), whatever its case."""
    banned = [n.lower() for n in names]
    for path in field_paths(df.schema):
        leaf = path.rsplit(".", 1)[-1].rstrip("[]{}").lower()
        if any(b in leaf if parts else b == leaf for b in banned):
            raise ContractError(f"forbidden feature field: {path}")
    return df


def leaking_keys(df: DataFrame, features: str, banned: Iterable[str]) -> DataFrame:
    """(feature, token, rows) for keys of a map column that hold a banned token."""
    keys = df.select(F.explode(F.map_keys(features)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    tokens = F.array(*[F.lit(b.lower()) for b in banned])
    return keys.select("feature", F.explode(F.filter(tokens, lambda t: F.contains(F.lower("feature"), t))).alias("token"), "rows")


# ---- rules for a value


def filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def one_of(c: Column, values: Iterable) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def between(c: Column, low: float | None = None, high: float | None = None) -> Column:
    ok = c.isNotNull() & ~F.isnan(c.cast("double"))
    if low is not None:
        ok = ok & (c >= low)
    return ok & (c <= high) if high is not None else ok


def all_filled(c: Column) -> Column:
    """An array without blank strings."""
    return F.coalesce(F.forall(c, filled), F.lit(False))


def is_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}$")


def spans_fit(text: Column, spans: Column) -> Column:
    """Every span's text stands at its offsets."""
    return F.coalesce(F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["text"])), F.lit(False))


# ---- on rows


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with `violations`, the names of the rules that a row breaks; a rule that is null is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations."""
    marked = violations(df, rules)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, rows) for every rule, those never broken too, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, name in enumerate(rules)])
    return counts.select(F.inline(pairs))


def enforce(df: DataFrame, rules: Mapping[str, Column], key: str | None = None) -> DataFrame:
    """df, failing while it runs at the first row that breaks a rule."""
    marked = violations(df, rules)
    name = F.col(key).cast("string") if key else F.lit("row")
    text = F.concat(F.lit("contract broken by "), F.coalesce(name, F.lit("null")), F.lit(": "), F.array_join("violations", ", "))
    checked = marked.where(F.when(F.size("violations") > 0, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
    return checked.drop("violations")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = duplicates(df, keys).limit(3).collect()
    if bad:
        raise ContractError(f"keys are not unique: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def inconsistent_groups(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups whose rows disagree in columns that should be the same in a group; null is a value."""
    image = F.struct(*[F.to_json(F.struct(c), {"ignoreNullFields": "false"}).alias(f"v{i}") for i, c in enumerate(columns)])
    return df.groupBy(*keys).agg(F.min(image).alias("a"), F.max(image).alias("b")).where("a <> b").select(*keys)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, nonzero, distinct, silent) for numeric columns; silent: a column that is constant or all zero."""
    d = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count_if(d[c].isNull()).alias(f"m{i}"), F.count_if(d[c] != 0).alias(f"z{i}"), F.count_distinct(d[c]).alias(f"d{i}")]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing"), F.col(f"z{i}").alias("nonzero"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(pairs)).withColumn("silent", (F.col("nonzero") == 0) | (F.col("distinct") <= 1))
