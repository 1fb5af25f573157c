"""Queries over sources, folds, designs, directions, locks and resumable work, on the given tables or files that Spark writes from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import aggregates, digests, directions, ranking, ridge_probe, sampling, sparse
from ..operators.stats import auroc
from ..sources import audits, readers, writers
from ..sources.storage import shared_dir
from ..streaming import work
from .base import SCORED, scored_documents, table


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


# ---- sources


def _broken_lines(spark, d, path: str) -> None:
    """Orders as JSON lines in order of their key, some of them broken."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    whole = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))
    line = F.when(F.col("o_orderkey") % 97 == 5, F.concat(F.lit('{"o_orderkey": '), "o_orderkey", F.lit(', "o_orderstatus'))).when(F.col("o_orderkey") % 97 == 6, F.concat(F.lit("["), "o_orderkey", F.lit("]"))).otherwise(whole)
    rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(line.alias("value")).write.text(path)


def line_numbers(spark, d) -> DataFrame:
    """Lines of files with their numbers: which are bad, and whether each stands where its key belongs."""
    path = _folder(spark, "lines")
    _broken_lines(spark, d, path)
    lines = readers.numbered_lines(spark, path).select("file", "line", F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("o_orderkey"))
    bad = readers.bad_lines(spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string").select("file", "line", F.lit(True).alias("bad"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey"))
    return lines.withColumn("in_place", F.col("line") == place).join(bad, ["file", "line"], "left").select("o_orderkey", F.coalesce("bad", F.lit(False)).alias("bad"), "in_place")


LINE_NUMBERS = "SELECT o_orderkey, o_orderkey % 97 IN (5, 6) AS bad, TRUE AS in_place FROM orders"


def tolerant_lines(spark, d) -> DataFrame:
    """Rows that a tolerant reader keeps by status, beside its counts of records and undecodable lines."""
    path = _folder(spark, "tolerant")
    _broken_lines(spark, d, path)
    rows, counts = readers.jsonl_tolerant(spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string")
    kept = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))
    return kept.join(F.broadcast(counts))  # one row


TOLERANT_LINES = "SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM orders WHERE o_orderkey % 97 IN (5, 6)) AS undecodable FROM orders WHERE o_orderkey % 97 NOT IN (5, 6) GROUP BY o_orderstatus"


def formats(spark, d) -> DataFrame:
    """Customers written and read in every format of records: rows, keys and lengths that come back."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(',"x"\nnext '), "c_mktsegment").alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    kind = "c_custkey long, c_name string, c_mktsegment string"
    out = None
    for suffix in ("jsonl", "csv", "parquet"):
        path = f"{_folder(spark, 'format')}.{suffix}"
        if suffix == "jsonl":
            writers.jsonl(rows, path)
        elif suffix == "csv":
            rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
        else:
            rows.write.parquet(path)
        back = readers.any_records(spark, path, kind if suffix == "jsonl" else None)
        one = back.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("c_custkey").cast("long")).alias("keys"), F.sum(F.length("c_name")).alias("letters"), F.count(F.nullif("c_mktsegment", F.lit(""))).alias("segments")).withColumn("format", F.lit(suffix))
        out = one if out is None else out.unionByName(one)
    return out


FORMATS = "SELECT f.format, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(sum(length(c_name) + length(c_mktsegment) + 10) AS BIGINT) AS letters, count(*) FILTER (c_custkey % 3 <> 0) AS segments FROM customer, (VALUES ('jsonl'), ('csv'), ('parquet')) AS f(format) GROUP BY f.format"


def file_audit(spark, d) -> DataFrame:
    """An audit of JSON-lines files: records, undecodable ones, fields, questions and answers."""
    path = _folder(spark, "audit")
    _broken_lines(spark, d, f"{path}/orders")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("Question"), F.length("text").alias("answer"))
    writers.jsonl(items, f"{path}/items")
    found = readers.audit(spark, f"{path}/*/*.json").unionByName(readers.audit(spark, f"{path}/orders/*.txt"))
    return found.groupBy(F.array_join("fields", ",").alias("fields"), "has_question", "has_answer").agg(F.sum("records").alias("records"), F.sum("undecodable").alias("undecodable"))


FILE_AUDIT = "SELECT 'Question,answer,id' AS fields, TRUE AS has_question, TRUE AS has_answer, count(*) AS records, 0 AS undecodable FROM benchmark UNION ALL SELECT 'o_orderkey,o_orderpriority,o_orderstatus', FALSE, FALSE, count(*), count(*) FILTER (o_orderkey % 97 IN (5, 6)) FROM orders"


def source_audit(spark, d) -> DataFrame:
    """Descriptors of files that hold orders as questions (CSV) and as units derived from them (Parquet), by kind of file."""
    path = _folder(spark, "sources")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat("o_orderpriority", F.lit(', "and"\nmore')).alias("question"), F.col("o_totalprice").alias("answer"))
    rows.write.option("header", True).option("escape", '"').csv(f"{path}/questions")
    rows.withColumnRenamed("question", "original_question").write.parquet(f"{path}/derived")
    found = audits.described(spark, [path]).where("records > 0")
    return found.groupBy("file_type", "source_type", "usable", F.array_join("fields", ",").alias("fields")).agg(F.sum("records").alias("records"))


SOURCE_AUDIT = "SELECT 'csv' AS file_type, 'raw_question_source' AS source_type, TRUE AS usable, 'answer,id,question' AS fields, count(*) AS records FROM orders UNION ALL SELECT 'parquet', 'derived_downstream', FALSE, 'answer,id,original_question', count(*) FROM orders"


# ---- templates


def template_holes(spark, d) -> DataFrame:
    """Sentences of orders held against a template with three holes: what fills them, or what is wrong."""
    key, status, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.floor("o_totalprice").cast("long").cast("string")
    head = F.when(key % 7 == 1, F.lit("Bill ")).otherwise(F.lit("Order "))
    middle = F.when(key % 7 == 2, F.lit(" for ")).otherwise(F.lit(" is "))
    tail = F.when(key % 7 == 3, F.lit(" all told, paid")).otherwise(F.lit(" all told"))
    text = F.concat(head, key.cast("string"), middle, F.when(key % 7 == 4, F.lit("")).when(key % 7 == 5, F.lit("that is and ")).otherwise(status), F.lit(" and "), price, tail)
    rows = table(spark, d, "orders").select("o_orderkey", X.template_fills(F.lit("Order [MASK] is [MASK] and [MASK] all told"), text).alias("f"))
    return rows.select("o_orderkey", "f.status", F.array_join("f.warnings", ", ").alias("warnings"), F.array_join(F.transform("f.fills", lambda h: F.concat(h["hole"].cast("string"), F.lit("="), h["text"], F.lit("@"), h["start"].cast("string"))), "; ").alias("fills"))


TEMPLATE_HOLES = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderkey % 7 WHEN 4 THEN '' WHEN 5 THEN 'that is' ELSE o_orderstatus END AS s, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders),
w AS (SELECT *, CASE k % 7 WHEN 1 THEN 'template_prefix_mismatch' WHEN 2 THEN 'template_suffix_mismatch' WHEN 3 THEN 'template_trailing_text_mismatch' WHEN 4 THEN 'empty_fill_span' ELSE '' END AS warnings,
  CASE WHEN k % 7 = 5 THEN ' and ' || price ELSE price END AS last FROM o)
SELECT k AS o_orderkey, CASE WHEN warnings = '' THEN 'ok' ELSE 'warning' END AS status, warnings,
  CASE WHEN k % 7 IN (1, 2) THEN '' ELSE '0=' || key || '@6; 1=' || s || '@' || (6 + length(key) + 4) || '; 2=' || last || '@' || (6 + length(key) + 4 + length(s) + 5) END AS fills
FROM w
"""


# ---- folds and designs


def label_folds(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.label_folds(docs, "lang", "doc_id", 5)[0].select("doc_id", F.col("fold").cast("int").alias("fold"))


LABEL_FOLDS = "WITH k AS (SELECT least(5, min(n)) AS k FROM (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)) SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || doc_id), doc_id) - 1) % k AS INTEGER) AS fold FROM documents, k WHERE lang IS NOT NULL"


def _grouped(spark, d) -> DataFrame:
    """Labelled documents in three folds of whole groups with both classes in each."""
    rows = scored_documents(spark, d).withColumn("grp", F.pmod("doc_id", F.lit(50)))
    return sampling.stratified_group_folds(rows, "grp", "quality", 3)


def profile_folds(spark, d) -> DataFrame:
    """Each group and how many folds it lies in, with its rows and positives."""
    return _grouped(spark, d).groupBy("grp").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("positives"))


PROFILE_FOLDS = f"SELECT doc_id % 50 AS grp, 1 AS folds, count(*) AS rows, CAST(sum(quality) AS BIGINT) AS positives FROM {SCORED} GROUP BY 1"


def fold_blocks(spark, d) -> DataFrame:
    """A dense block of each fold's design: scaled by what is outside the fold."""
    rows = sampling.folds(scored_documents(spark, d), "source", 3, seed=2)
    got, _ = sparse.designs(rows, sparse.Rung(None, {"f": ["score", "other"]}), id="doc_id", label="quality", fold="fold", inner=None, k=3)
    return got.select(F.col("id").alias("doc_id"), "design", F.round(F.col("vals")[0], 6).alias("x0"), F.round(F.col("vals")[1], 6).alias("x1"))


def _scaled(c: str) -> str:
    return f"round(({c} - m_{c}) / CASE WHEN s_{c} < 1e-12 THEN 1.0 ELSE s_{c} END / sqrt(2.0), 6)"


FOLD_BLOCKS = f"""
WITH s AS (SELECT * FROM {SCORED}), g AS (SELECT source, (row_number() OVER (ORDER BY sha256('2:' || source), source) - 1) % 3 AS fold FROM (SELECT DISTINCT source FROM s)),
r AS (SELECT s.*, fold FROM s JOIN g USING (source)), t AS (SELECT unnest([0, 1, 2]) AS design),
m AS (SELECT design, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('score', 'other'))} FROM r, t WHERE fold <> design GROUP BY design)
SELECT doc_id, CAST(design AS INTEGER) AS design, {_scaled('score')} AS x0, {_scaled('other')} AS x1 FROM r, m
"""


def text_ladder(spark, d) -> DataFrame:
    """Rungs of text, of scores and of both over the same folds: what each fold chose, and its AUROC."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    rows = _grouped(spark, d).join(texts.dropDuplicates(["doc_id"]), "doc_id")
    rungs = {"O": sparse.Rung("text", {"f": ["score"]}), "H": sparse.Rung(None, {"h": ["other"]}), "O_H": sparse.Rung("text", {"f": ["score"], "h": ["other"]})}
    scores, report = sparse.ladder(rows, rungs, id="doc_id", label="quality", group="grp", fold="fold", k=3, grid=(0.1, 1.0), inner_k=2, most_terms=20_000, tolerance=1e-3)
    found = None
    for name in rungs:
        one = auroc(scores, f"oof_{name}", "y", ["fold"]).select(F.lit(name).alias("rung"), "fold", "auroc")
        found = one if found is None else found.unionByName(one)
    return report.select("rung", "fold", "c", "features").join(found, ["rung", "fold"])


def label_probe(spark, d) -> DataFrame:
    """Labels of vectors as five folds of probes tell them: how often each is taken for which."""
    rows, k = sampling.label_folds(table(spark, d, "embeddings"), "label", "vec_id", 5)
    got = ridge_probe.probe(rows, key="vec_id", label="label", x="embedding", fold="fold", k=k)
    return got.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("margin"), 4).alias("margin"))


# ---- risk and position


def discrete_aurc(spark, d) -> DataFrame:
    """Mean risk of the curve of low-quality documents accepted by score, and its risk at four fifths."""
    curve = ranking.risk_coverage(scored_documents(spark, d), "score", "doc_id", F.col("quality") == 0, [0.1, 0.2, 0.4, 0.6, 0.8, 1.0])
    return ranking.discrete_aurc(curve).select(F.round("aurc", 9).alias("aurc"), F.round("risk_at", 9).alias("risk_at"))


DISCRETE_AURC = f"""
WITH s AS (SELECT row_number() OVER (ORDER BY score, doc_id) AS r, count(*) OVER () AS n, 1 - quality AS w FROM {SCORED}), c AS (SELECT unnest([0.1, 0.2, 0.4, 0.6, 0.8, 1.0]) AS c),
p AS (SELECT c, avg(w) AS risk FROM s, c WHERE r <= greatest(1, CAST(round_even(n * CAST(c AS DOUBLE), 0) AS BIGINT)) GROUP BY c)
SELECT round(avg(risk), 9) AS aurc, round(max(risk) FILTER (c = 0.8), 9) AS risk_at FROM p
"""


def fixed_letters(spark, d) -> DataFrame:
    """Choices of customers in shuffled order: which texts always stand under one letter."""
    texts = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"), F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", texts.alias("texts"))
    return aggregates.fixed_letters(rows.select(sampling.shuffled_choices(F.col("texts"), F.col("c_custkey"), 3).alias("choices")), "choices")


FIXED_LETTERS = """
WITH c AS (SELECT c_custkey, unnest(['alpha', 'beta', 'gamma', c_mktsegment]) AS text, unnest([0, 1, 2, 3]) AS i FROM customer),
l AS (SELECT text, row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('3:' || c_custkey || ':' || i)) AS letter FROM c)
SELECT text, count(*) AS times, count(DISTINCT letter) AS letters, count(*) >= 2 AND count(DISTINCT letter) = 1 AS fixed FROM l GROUP BY text
"""


def majority_baseline(spark, d) -> DataFrame:
    """The most common language of documents, its share, and whether that is severe."""
    return aggregates.majority_baseline(table(spark, d, "documents"), "lang").select("label", "rows", F.round("share", 9).alias("share"), "severe")


MAJORITY_BASELINE = "WITH n AS (SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT label, CAST((SELECT sum(n) FROM n) AS BIGINT) AS rows, round(n / (SELECT sum(n) FROM n)::DOUBLE, 9) AS share, n / (SELECT sum(n) FROM n)::DOUBLE > 0.4 AS severe FROM n ORDER BY n DESC, label LIMIT 1"


# ---- directions and controls


def loo_vectors(spark, d) -> DataFrame:
    """The mean of all other vectors, by a digest, and the length of the first direction of the others."""
    got = directions.without_each(table(spark, d, "embeddings"), "vec_id", "embedding", 64, rank=8, tolerance=1e-4)
    weighed = F.aggregate(F.transform("mean", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select("vec_id", F.round(weighed, 5).alias("mean_digest"), F.round(F.aggregate("component", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


LOO_VECTORS = "WITH v AS (SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * i)) AS w FROM embeddings) SELECT vec_id, round((sum(w) OVER () - w) / (count(*) OVER () - 1), 5) AS mean_digest, 1.0::DOUBLE AS length FROM v"


def changed_partners(spark, d) -> DataFrame:
    """Each vector and the one of its label that it meets in a control."""
    return directions.partnered(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id", ["vec_id"], seed=4)


_PARTNER = "CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN coalesce(lead({c}) OVER w, first_value({c}) OVER (PARTITION BY label ORDER BY sha256('{s}:' || vec_id), vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END"
CHANGED_PARTNERS = f"SELECT vec_id, label, {_PARTNER.format(c='vec_id', s=4)} AS other_vec_id FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY sha256('4:' || vec_id), vec_id)"


def control_percentile(spark, d) -> DataFrame:
    """How a mean product of two components stands among those with components of other vectors of the label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    got = directions.percentile_among(rows, ["label"], "vec_id", "x", "y", lambda a, b: a * b, rounds=4)
    return got.select("rows", F.round("observed", 7).alias("observed"), F.round("mean_control", 7).alias("mean_control"), "percentile")


CONTROL_PERCENTILE = "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (" + " UNION ALL ".join(
    f"SELECT count(o) AS n, avg(x * y) FILTER (o IS NOT NULL) AS observed, avg(x * o) AS control FROM (SELECT x, y, {_PARTNER.format(c='y', s=s)} AS o FROM e WINDOW w AS (PARTITION BY label ORDER BY sha256('{s}:' || vec_id), vec_id))" for s in range(4)
) + ") SELECT max(n) AS rows, round(max(observed), 7) AS observed, round(avg(control), 7) AS mean_control, avg(CASE WHEN control <= observed THEN 1.0 ELSE 0.0 END) AS percentile FROM c"


# ---- locks and work


def _order_texts(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))


def table_digests(spark, d) -> DataFrame:
    """The digest of orders by column, and of whole rows."""
    return digests.table_digest(_order_texts(spark, d))


_ORDER_TEXTS = {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderpriority": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END", "o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)"}


def _digest_sql(name: str, said: str, nulls: str, size: str) -> str:
    h = f"CAST('0x' || substr(sha256({said}), 1, 15) AS BIGINT)"
    return f"SELECT '{name}' AS \"column\", count(*) AS rows, CAST({nulls} AS BIGINT) AS nulls, CAST({size} AS BIGINT) AS bytes, CAST(sum({h}) AS VARCHAR) AS total, bit_xor({h}) AS parity FROM o"


_SAID = {c: f"coalesce('=' || {c}, 'null')" for c in _ORDER_TEXTS}
TABLE_DIGESTS = "WITH o AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _ORDER_TEXTS.items()) + " FROM orders) " + " UNION ALL ".join(
    [_digest_sql(c, f"'{c}:' || {_SAID[c]}", f"count(*) FILTER ({c} IS NULL)", f"coalesce(sum(octet_length(encode({c}))), 0)") for c in _ORDER_TEXTS]
    + [_digest_sql("*", " || ".join(f"length({s}) || ':' || {s}" for s in _SAID.values()), "0", " + ".join(f"coalesce(sum(octet_length(encode({c}))), 0)" for c in _ORDER_TEXTS))]
)


def lock_differences(spark, d) -> DataFrame:
    """What a lock says of orders with some prices changed, and of orders without some rows."""
    path = _folder(spark, "lock")
    rows = _order_texts(spark, d)
    digests.lock(rows, path)
    then = writers.latest(spark, path)
    changed = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    told = lambda df, case: digests.differences(digests.table_digest(df), then).select(F.lit(case).alias("case"), "column", "what")
    return told(changed, "changed").unionByName(told(rows.where("o_orderkey % 2 = 0"), "lost")).unionByName(told(rows.orderBy(F.desc("o_custkey")), "reordered"))


LOCK_DIFFERENCES = "SELECT 'changed' AS \"case\", unnest(['*', 'o_totalprice']) AS \"column\", 'values' AS what UNION ALL SELECT 'lost', unnest(['*', 'o_orderkey', 'o_custkey', 'o_orderpriority', 'o_totalprice']), 'rows'"


def work_replay(spark, d) -> DataFrame:
    """Events as units of work, done by a resumable stream that runs twice: each stands once, with its result and attempts."""
    request = T.StructType().add("unit_id", "string").add("fingerprint", "string").add("value", "double")
    result = T.StructType().add("unit_id", "string").add("fingerprint", "string").add("error", "string").add("cents", "long")
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("unit_id"), F.col("value"))
    units = e.select("unit_id", work.fingerprint(["unit_id", "value"], {"scale": 100}).alias("fingerprint"), "value")
    root = _folder(spark, "work")
    work.requested(units, root)

    def cents(rows: DataFrame) -> DataFrame:
        bad = F.when(F.col("unit_id").cast("long") % 10 == 3, F.lit("refused"))
        return rows.select("unit_id", "fingerprint", bad.alias("error"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"))

    for _ in range(2):
        work.worked(spark, root, request, cents, result, most_attempts=2)
    done = work.outputs(spark, root, result)
    states = work.states(units, work.log(spark, root), done).select("unit_id", "state", "attempts")
    return states.join(work.results(units, done).select("unit_id", "cents"), "unit_id", "left")


WORK_REPLAY = "SELECT DISTINCT CAST(event_id AS VARCHAR) AS unit_id, CASE WHEN event_id % 10 = 3 THEN 'failed' ELSE 'done' END AS state, CASE WHEN event_id % 10 = 3 THEN 2 ELSE 1 END AS attempts, CASE WHEN event_id % 10 <> 3 THEN CAST(floor(coalesce(value, 0) * 100) AS BIGINT) END AS cents FROM events"

QUERIES = {name: (globals()[name], globals().get(name.upper())) for name in (
    "line_numbers", "tolerant_lines", "formats", "file_audit", "source_audit", "template_holes", "label_folds", "profile_folds", "fold_blocks", "text_ladder", "label_probe", "discrete_aurc", "fixed_letters", "majority_baseline", "loo_vectors", "changed_partners", "control_percentile", "table_digests",
    "lock_differences", "work_replay",
)}
