"""What several operators of this subpackage share: shared storage, word rule, label samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import drop_since, drop_stored, shared_dir, stored, tables_made  # noqa: F401

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, what is stored passes rows to Python a thousand at a time: for rows that may be large, such as sets of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True for documents kept from training; a null id is never held out (it is never labelled either)."""
    return F.coalesce(crc_of_id(doc_id) % modulus == remainder, F.lit(False))


def sampled_labels(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, y) of at most per_class labelled training rows of either class.

    Training rows are those whose crc32(doc_id) mod 5 is not 0. Rows are taken in the order of a hash
    of doc_id, so the sample is random and repeatable. A document labelled twice counts once, with its
    largest label; null labels and ids are left out. The result has at most 2 * per_class rows.
    """
    rows = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(11))
    return rows.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("y = 1").orderBy(order, "doc_id").limit(per_class))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) for a sample of labels whose size is bounded by sampled_labels, hence the broadcast."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
