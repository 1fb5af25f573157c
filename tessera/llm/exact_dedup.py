"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut at places that its own content fixes: a chunk is at least `least` code points long and ends
after the next sentence or line end, or at `most` code points. Each chunk gets an identifier (its sha256).
The identifiers are verified in the chunk store: every distinct chunk text is moved once, map-side
deduplicated, and an identifier under which two texts are found is void, so that its chunks go by their
whole text instead. A document is then its recipe, the ordered list of chunk identifiers; two texts are
equal exactly when their recipes are. Recipes, about a thirtieth of the text, are what is grouped and joined.

Skew: grouping is by partial sums, so a group of copies that holds a third of all rows reaches the reducer
as one row per task. The join back is an equi-join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """The text as an array of chunks whose concatenation is the text; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}})"), F.lit(0))


def recipes(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """doc_id, text_sha256 and recipe (array of verified chunk identifiers) for each row; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", text.alias("text")).select("doc_id", "text", chunks(F.col("text"), least, most).alias("chunks"))
    rows = stored(cut.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.transform("chunks", chunk_id).alias("recipe")), "recipes")
    void = void_ids(docs, least, most)
    # empty unless sha256 collides within the corpus; a left anti join over the exploded recipes would cost a shuffle for that, so the list is looked at first
    if void.isEmpty():
        return rows
    return _with_whole_chunks(docs, void, least, most)


def chunk_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk.cast("binary"), 256))


def void_ids(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """Identifiers that stand for more than one chunk text."""
    store = docs.where(F.col("text") != "").select(F.explode(chunks(F.col("text"), least, most)).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("uses"))
    return store.select(chunk_id(F.col("chunk")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id")


def _with_whole_chunks(docs: DataFrame, void: DataFrame, least: int, most: int) -> DataFrame:
    """Recipes in which chunks of void identifiers stand as whole texts."""
    tagged = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagged = stored(tagged, "tagged")
    parts = tagged.select("row", F.posexplode(chunks(F.col("text"), least, most)).alias("at", "chunk")).withColumn("id", chunk_id(F.col("chunk")))
    parts = parts.join(void.withColumn("void", F.lit(True)), "id", "left").select("row", "at", F.when(F.col("void"), F.col("chunk").cast("binary")).otherwise(F.col("id")).alias("id"))
    lists = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("l")).select("row", F.col("l.id").alias("recipe"))
    return tagged.join(lists, "row", "left").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.coalesce("recipe", F.array().cast("array<binary>")).alias("recipe"))


def duplicates(docs: DataFrame, least: int = 512, most: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null and empty texts are equal. Rows that repeat
    doc_id and text are one document said twice: they count in group_size and report the same kept. Where
    all ids of a group are null, keep_id is null and the rows are kept. Texts of any length are cut into chunks and
    compared whole. Empty table: no rows. Only doc_id and text are read.
    """
    rows = recipes(docs, least, most)
    # a table of its own, so that both sides of the join come straight from a shuffle and a hot recipe can be split
    groups = stored(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, one for each distinct text.

    Whole rows move once, to be joined with the keys of those that go; rows that repeat doc_id and text
    leave one. Rows of null id stay only if their text has no other.
    """
    found = stored(duplicates(docs), "duplicates")
    go = found.where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    repeated = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_sha256")
    sha, gone, again = (fresh(docs, x) for x in ("sha", "gone", "again"))
    hashed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    marks = go.withColumn("m", F.lit(0)).unionByName(repeated.withColumn("m", F.lit(1))).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(again), "m")
    mark = fresh(docs, "mark")
    marks = marks.withColumnRenamed("m", mark)
    rows = hashed.join(marks, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(sha) == F.col(again)), "left").drop(gone, again)
    once = rows.where(F.col(mark).isNull())
    if repeated.isEmpty():
        return once.select(*docs.columns)
    many = rows.where(F.col(mark) == 1).dropDuplicates(["doc_id", sha])
    return once.unionByName(many).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
