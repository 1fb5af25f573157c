"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact budgets.

Every document gets a hash-random key. Documents are sorted by source and key into ranges, one a task, whatever
the size of a source; rows that share a key are told apart by a hash of the text and by a row number, so that
repeated ids can't fill a range. Each task sums words within its range, and one small table, a row for each
range and source that meet, has what lies before. A source's target, divided by its size, gives whole epochs
that every document repeats; the rest of the budget is cut exactly where the prefix sum reaches it, if need be
inside a document.

Only ids, keys and sizes are sorted. The mix itself follows from one boundary document per source: those before
it are taken once more, those after it are not, so texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ranking import global_row_number
from .common import WORD, drop_stored, stored

#: No source gives more than so many times its own words.
REPEATS = 3


def words(text: Column) -> Column:
    """Number of words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), total: int | None = None) -> list[tuple[str | None, int, float]]:
    """(source, size, target) for sources and their sizes.

    Sources are weighed in code point order, null last, with the repeating weights. They share `total`
    (all words, if not given); a target stops at REPEATS times its source's size and the excess is shared
    again by weight among the others until no target is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    total = sum(n for _, n in order) if total is None else total
    # those that stop are the first in the order of limit over weight
    by = sorted(range(len(order)), key=lambda i: (order[i][1] * REPEATS / weight[i], i))
    left, share, out = total, sum(weight), [0.0] * len(order)
    for at, i in enumerate(by):
        limit = order[i][1] * REPEATS
        if left * weight[i] > limit * share:
            out[i] = float(limit)
            left -= limit
            share -= weight[i]
        else:
            for j in by[at:]:
                out[j] = left * weight[j] / share
            break
    return [(s, n, t) for (s, n), t in zip(order, out, strict=True)]


def key(seed: int = 0) -> Column:
    """A hash-random key for a document: sha256 of the seed and its id, as hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)


def _order(seed: int) -> Column:
    """Where a document stands in its source: by key, then id, then a hash of the text."""
    return F.struct(F.unhex(key(seed)).alias("key"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("tie"))


def _light(docs: DataFrame, seed: int) -> DataFrame:
    """What the mix is decided by: doc_id, source, size, place in the source, and a row number."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _order(seed).alias("at"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "light")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with the words of their source within this range up to and with them, and the range's number."""
    from pyspark import TaskContext

    part, last, carry = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column("source")
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        code = source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        total = np.cumsum(size)
        before = np.repeat(total[starts] - size[starts], np.diff(np.append(starts, len(size))))
        running = total - before
        if source[0].as_py() == last:
            running[: starts[1] if len(starts) > 1 else len(size)] += carry
        last, carry = source[-1].as_py(), int(running[-1])
        columns = [*batch.columns, pa.array(running, pa.int64()), pa.array(np.full(len(size), part, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "running", "part"])


def _placed(docs: DataFrame, weights: tuple[int, ...], seed: int, most_sources: int, ranges: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, source, size, at and struct m (source_size, target, epochs, extra) of every row; and the tables behind it."""
    spark = docs.sparkSession
    light = _light(docs, seed)
    found = light.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources: raise most_sources if the driver can hold a row for each")
    table = F.broadcast(spark.createDataFrame(targets([(r["source"], r["size"]) for r in found], weights), StructType([StructField("s_", light.schema["source"].dataType), StructField("total", LongType())]).add("target", "double")))
    order = ["source", "at", "row"]
    spread = light.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    summed = stored(spread.mapInArrow(_summed, StructType([*light.schema.fields, StructField("running", LongType()), StructField("part", LongType())])), "summed")
    # a row for each range and source that meet: at most as many as there are ranges and sources together
    parts = summed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = parts.select(F.col("source").alias("s2_"), F.col("part").alias("part2"), (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    out = summed.join(table, F.col("source").eqNullSafe(F.col("s_"))).join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("s2_")) & (F.col("part") == F.col("part2")))
    start = F.col("before") + F.col("running") - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("total") > 0, (budget - budget % F.col("total")) / F.col("total")).otherwise(0).cast("long")
    extra = F.least(F.greatest(budget - epochs * F.col("total") - start, F.lit(0)), F.col("size")).cast("long")
    plan = F.struct(F.col("total").alias("source_size"), "target", epochs.alias("epochs"), extra.alias("extra"))
    return out.select("doc_id", "source", "size", "at", plan.alias("m")), [light, summed]


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), *, seed: int = 0, most_sources: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document.

    taken counts the words that the mix takes from the document, repeats counted, and is at most REPEATS
    times its size. The taken words of a source sum to its target, rounded down. The null source is a source.
    Null text has no words. Equal keys (repeated ids) follow each other in the order of a hash of their text; rows equal in
    id, source and text are interchangeable. The same table gives the same result again. Texts of any length count
    whole. Empty table: no rows. Only doc_id, text and source are read, once, whatever other columns are called.

    The sums by source go to the driver and back as a broadcast, one row per source; more than most_sources raise an error.
    ranges is the number of ranges to sort into, by default that of shuffle partitions; it doesn't change results.
    """
    out, (light, _) = _placed(docs, weights, seed, most_sources, ranges)
    drop_stored(light)
    return out.select("doc_id", "size", "m.source_size", "m.target", (F.col("m.epochs") * F.col("size") + F.col("m.extra")).alias("taken"))


def realised(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), *, seed: int = 0, most_sources: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """The documents of the mix: a row for each epoch that takes the document whole, and one with its first
    words where the budget ends inside it. Columns are those of docs; n_chars, if there, follows the text.
    Documents without a word, null ones too, are not in a mix of words. Rows said several times are as many documents, which
    follow each other in the mix; texts of any length count whole, and a cut falls between words; an empty table stays empty.

    The boundary of a source is the first document that isn't taken once more in full. One row per source, it is
    broadcast, and every document is decided by comparing its place with it. Where several rows equal in id and text
    stand at a boundary, those alone are numbered."""
    placed, tables = _placed(docs, weights, seed, most_sources, ranges)
    short = placed.where((F.col("size") > 0) & (F.col("m.extra") < F.col("size")))
    first = stored(short.groupBy("source").agg(F.min("at").alias("at"), F.min("m.epochs").alias("epochs")), "boundaries")
    held = F.broadcast(first.select(F.col("source").alias("s_"), F.col("at").alias("end"), "epochs"))
    equal = placed.join(held, F.col("source").eqNullSafe(F.col("s_")) & (F.col("at") == F.col("end")))
    ends = stored(equal.groupBy("s_", "end", "epochs").agg(F.count(F.lit(1)).alias("rows"), F.sum("m.extra").alias("extra")), "ends")
    for table in (*tables, first):
        drop_stored(table)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("source").alias("source"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("spoken"), _order(seed).alias("at"))
    keyed = keyed.where("spoken").join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("s_")))
    at_end = F.col("at") == F.col("end")
    copies = (F.col("epochs") + F.when(F.col("at") < F.col("end"), 1).otherwise(0)).cast("int")
    extra = F.when(at_end & (F.col("rows") == 1), F.col("extra")).otherwise(0)
    out = _repeated(keyed.where(~at_end | (F.col("rows") == 1)).select("d", copies.alias("copies"), extra.alias("extra")))
    if not ends.where("rows > 1").isEmpty():
        tied = stored(keyed.where(at_end & (F.col("rows") > 1)).withColumn("row", F.monotonically_increasing_id()), "tied")
        numbered = global_row_number(tied, [F.col("source"), F.col("row")], "number")
        before = F.broadcast(numbered.groupBy("source").agg((F.min("number") - 1).alias("before")).withColumnRenamed("source", "s2_"))
        left = F.col("extra") - (F.col("number") - F.col("before") - 1) * words(F.col("d.text"))
        share = numbered.join(before, F.col("source").eqNullSafe(F.col("s2_"))).withColumn("left", F.greatest(left, F.lit(0)))
        whole = F.col("left") >= words(F.col("d.text"))
        out = out.unionByName(_repeated(share.select("d", (F.col("epochs") + whole.cast("int")).cast("int").alias("copies"), F.when(whole, 0).otherwise(F.col("left")).alias("extra"))))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns}
    columns["text"] = F.when(F.col("take") < 0, F.col("d.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("d.text", F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("take").cast("int")), ""))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("take") < 0, F.col("d.n_chars")).otherwise(F.length(columns["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows d as often as `copies` says, with take -1, and one with take `extra` where that isn't 0."""
    takes = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("copies")), F.when(F.col("extra") > 0, F.array(F.col("extra").cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return rows.select("d", F.explode(takes).alias("take"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS i FROM d GROUP BY source
), w AS (SELECT *, 1 + (i - 1) % 3 AS w, 3 * n AS lim FROM s),
o AS (
  SELECT *, (SELECT sum(n) FROM w) - coalesce(sum(lim) OVER (ORDER BY lim / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER (ORDER BY lim / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY lim / w, i) AS j
  FROM w
), f AS (SELECT min(j) AS j FROM o WHERE left_ * w <= lim * share),
t AS (
  SELECT o.source, CAST(o.n AS BIGINT) AS source_size,
         CASE WHEN f.j IS NULL OR o.j < f.j THEN CAST(o.lim AS DOUBLE)
              ELSE CAST((SELECT left_ FROM o WHERE j = f.j) * o.w AS DOUBLE) / CAST((SELECT share FROM o WHERE j = f.j) AS DOUBLE) END AS target
  FROM o, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.text ROWS UNBOUNDED PRECEDING) - d.size AS start,
         CAST(floor(t.target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM e
"""
