"""The corpus pipeline: stages from raw documents to token counts of the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model is learned from the labels of documents at hand.

    Null and empty texts hold no evidence and stay, texts of any length count whole, repeated rows all get the same
    score, an empty table stays empty, and without labels of both classes every document has the share of toxic labels
    (none: 0.5 less a little) as its score. Other columns pass, whatever their names."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.scored(docs, model)
    return out.where(F.col(out.columns[-1])["score"] < 0.5).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text: the one with the largest doc_id.

    Null and empty texts are one text, of which one row stays. Rows that repeat id and text leave one; a row of null id
    stays only if its text has no other. An empty table stays empty; other columns pass, whatever their names."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more): the smallest doc_id.

    Null texts and those without words are near nothing and stay, as do rows of null id. Rows that repeat an id stay or
    go together. An empty table stays empty; other columns pass, whatever their names."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents as often as it takes them, the last of a source cut where the budget ends.

    Null texts and those without words are no part of a mix of words. The null source is a source. Repeated ids and rows
    follow each other in an order that reruns repeat. An empty table stays empty; other columns pass."""
    return mixing.realised(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the digests of the BPE ids of each document of the mix, a row for each of its rows.

    Null and empty texts have no ids; texts of any length count whole; an empty table gives no rows."""
    import public_tokenizers

    out = bpe.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "source", f"{out.columns[-1]}.*")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokenised),
]

#: The toxicity and BPE stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each on the stored result of the one before, which is deleted once it has been read.

    Only the columns of COLUMNS are carried; others of documents don't reach the result. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    mark = common.tables_made()
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.drop_since(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
