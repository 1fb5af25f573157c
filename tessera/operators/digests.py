"""Locks on tables: digests that know every row and value, but not the order or partitions rows come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LockError(ValueError):
    """A table isn't the one that was locked."""


def _hash(text: Column) -> Column:
    """60 bits of SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _said(name: str) -> Column:
    """A value as text that no other value of the column shares: a null is not the word for it."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit("null"))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, bytes, total, parity): one row for each column, and one called `*` for whole rows.

    total is the sum and parity the exclusive or of a hash of each value (of each row, for `*`), so that a changed, lost or doubled
    row shows, in whatever order rows are read. bytes is the length of the values as text, what they would about take as
    uncompressed files. One aggregate over the table, with a few numbers a task. Columns must have a form as text; arrays, maps and structs are
    taken by their JSON. An empty table has totals of 0."""
    names = columns or df.columns
    plain = df.select(*[(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if df.schema[c].dataType.typeName() in ("array", "map", "struct", "variant") else F.col(f"`{c}`")).alias(c) for c in names])
    length = lambda c: F.octet_length(F.col(f"`{c}`").cast("string"))
    row = F.concat(*[F.concat(F.length(_said(c)).cast("string"), F.lit(":"), _said(c)) for c in names])
    asked = [(c, _hash(F.concat(F.lit(f"{c}:"), _said(c))), F.count_if(F.col(f"`{c}`").isNull()), F.coalesce(F.sum(length(c)), F.lit(0))) for c in names]
    nothing = F.lit(0).cast("long")
    asked.append(("*", _hash(row), nothing, None))
    hashed = plain.select("*", *[h.alias(f"h{i}_") for i, (_, h, _, _) in enumerate(asked)])
    sizes = [b for _, _, _, b in asked[:-1]]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (_, _, nulls, size) in enumerate(asked):
        aggs += [(nulls if i < len(names) else F.max(nulls)).alias(f"n{i}_"), (size if size is not None else sum(sizes[1:], sizes[0])).alias(f"b{i}_"), F.coalesce(F.sum(F.col(f"h{i}_").cast("decimal(38,0)")), F.lit(0)).alias(f"t{i}_"), F.coalesce(F.bit_xor(f"h{i}_"), F.lit(0)).alias(f"x{i}_")]
    one = hashed.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.coalesce(F.col(f"n{i}_"), F.lit(0)).cast("long").alias("nulls"), F.col(f"b{i}_").cast("long").alias("bytes"), F.col(f"t{i}_").cast("string").alias("total"), F.col(f"x{i}_").cast("long").alias("parity")) for i, (c, _, _, _) in enumerate(asked)]
    return one.select(F.inline(F.array(*cells)))


def differences(now: DataFrame, then: DataFrame) -> DataFrame:
    """(column, what) of what two digests disagree in: a column that is gone or new, rows, nulls, values."""
    a, b = (d.select("column", F.struct("rows", "nulls", "bytes", "total", "parity").alias(n)) for d, n in ((now, "a"), (then, "b")))
    what = F.when(F.col("a").isNull(), "gone").when(F.col("b").isNull(), "new").when(F.col("a.rows") != F.col("b.rows"), "rows").when(F.col("a.nulls") != F.col("b.nulls"), "nulls").otherwise("values")
    return a.join(b, "column", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("column", what.alias("what"))


def lock(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Keep the digest of a table at `path`."""
    from ..sources.writers import replaced

    replaced(table_digest(df, columns), path)


def unlocked(df: DataFrame, path: str) -> DataFrame:
    """df, if it is the table whose digest is at `path`; else an error says which columns differ, and how. A path without a digest is an error too."""
    from ..sources.writers import latest

    try:
        then = latest(df.sparkSession, path)
    except ValueError as e:
        raise LockError(f"no lock at {path}") from e
    names = [r["column"] for r in then.collect() if r["column"] != "*"]  # one row a column
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise LockError(f"columns are gone: {', '.join(missing)}")
    found = differences(table_digest(df, names), then).orderBy("column").collect()
    if found:
        raise LockError("; ".join(f"{r['column']}: {r['what']}" for r in found))
    return df
