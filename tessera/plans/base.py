"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of benchmark items and documents: item_id, text, origin (the table)."""
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("item_id"), "text", F.lit(name).alias("origin"))
    return of("benchmark", "item_id").unionByName(of("documents", "doc_id"))


def sql_values(rows: list[tuple], names: list[str]) -> str:
    """The rows as a SQL VALUES list with column names."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + f") AS v({', '.join(names)})"


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two stand-in scores: doc_id, source, lang, quality, toxic, score, other."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", ((F.col("n_chars") * 7919) % 1000 / 1000.0).alias("score"), ((F.col("n_chars") * 104729 + F.col("doc_id")) % 997 / 997.0).alias("other"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")


#: The same in SQL.
SCORED = "(SELECT doc_id, source, lang, quality, toxic, ((n_chars * 7919) % 1000) / 1000.0::DOUBLE AS score, ((n_chars * 104729 + doc_id) % 997) / 997.0::DOUBLE AS other FROM labels JOIN documents USING (doc_id))"


#: Rows of a task where tables are dealt: what a task sorts then stays the same, however large the table is.
TASK_ROWS = 100_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its rows need, so that what follows by these keys needs no other shuffle and no large task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys)


#: Types that stand for a span's, by a number modulo their count.
TYPES = ["number", "number_unit", "rate", "comparison", "negation", "condition", "operation", "question_target", "object", "number"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored spans of questions: question_id, span_id, n (a number), span_type, status, bucket and signals in [0, 1]."""
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"), F.min("l_quantity").cast("long").alias("q"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    part = lambda expr, m: ((expr % m) / float(m - 1)).cast("double")
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    out = rows.select(o.alias("question_id"), F.concat_ws("-", o, n, p).alias("span_id"), F.col("q").alias("n"), kind.alias("span_type"), F.col("f"), (F.col("s") % 4).cast("int").alias("bucket"), part(p * 7 + n, 101).alias("surface"), part(p * 7 + n * 13, 97).alias("hidden"), part(F.col("s") * 31 + o, 89).alias("attention"), part(F.col("q") * 17 + p, 83).alias("output"), part(o * 3 + p, 91).alias("current"))
    status = F.when(F.col("span_type").isin("number", "number_unit", "rate"), F.when(F.col("f") == "R", "on_solution_path_number").when(F.col("f") == "A", "off_solution_path_number").otherwise("ambiguous_number"))
    return out.select("*", status.alias("status"), ((F.col("hidden") + F.col("attention")) / 2.0).alias("fused")).drop("f")


_CASE = "CASE p % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
#: The same in SQL.
SPANS = f"""(SELECT *, CASE WHEN span_type IN ('number', 'number_unit', 'rate') THEN CASE f WHEN 'R' THEN 'on_solution_path_number' WHEN 'A' THEN 'off_solution_path_number' ELSE 'ambiguous_number' END END AS status, (hidden + attention) / 2.0::DOUBLE AS fused
FROM (SELECT o AS question_id, o || '-' || l || '-' || p AS span_id, q AS n, {_CASE} AS span_type, f, CAST(s % 4 AS INTEGER) AS bucket, ((p * 7 + l) % 101) / 100.0::DOUBLE AS surface, ((p * 7 + l * 13) % 97) / 96.0::DOUBLE AS hidden, ((s * 31 + o) % 89) / 88.0::DOUBLE AS attention, ((q * 17 + p) % 83) / 82.0::DOUBLE AS output, ((o * 3 + p) % 91) / 90.0::DOUBLE AS current
FROM (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_partkey AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3)))"""
