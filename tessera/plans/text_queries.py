"""Queries over texts: spans, ids, numbers, answers, normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import spans as S
from .base import all_texts, literal, sql_values, table

NUMBER = r"\d+(?:\.\d+)?%?"


def number_spans(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.inline(X.matches(F.col("text"), NUMBER)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("docs"), F.sum("start").cast("long").alias("starts"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


NUMBER_SPANS = rf"""
WITH m AS (SELECT doc_id, source, regexp_extract_all(text, '{NUMBER}') AS m, string_split_regex(text, '{NUMBER}') AS g FROM documents),
s AS (SELECT doc_id, source, unnest(range(1, len(m) + 1)) AS i, m, g FROM m),
o AS (SELECT doc_id, source, length(m[i]) AS n, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st FROM s)
SELECT source, count(*) AS spans, count(DISTINCT doc_id) AS docs, CAST(sum(st) AS BIGINT) AS starts, CAST(sum(n) AS BIGINT) AS chars FROM o GROUP BY source
"""

PHRASES = [(k, p) for k, ps in L.ENGLISH.items() for p in ps]


def lexicon_counts(spark, d):
    """Each phrase is sought only in texts that hold its letters somewhere: a plain search over a text in lower case, made once,
    spares most of the patterns."""
    texts = table(spark, d, "documents").select("text", F.lower("text").alias("low"))
    counts = [F.sum(F.when(F.contains(F.col("low"), F.lit(p.lower())), F.regexp_count("text", F.lit(rf"(?i)(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"))).otherwise(0)).cast("long").alias(f"c{i}") for i, (_, p) in enumerate(PHRASES)]
    one = texts.agg(*counts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(p).alias("phrase"), F.coalesce(f"c{i}", F.lit(0).cast("long")).alias("found")) for i, (k, p) in enumerate(PHRASES)])))


LEXICON_COUNTS = "SELECT type, phrase, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i)\\b' || phrase || '\\b'))), 0) AS BIGINT) AS found FROM documents, " + sql_values(PHRASES, ["type", "phrase"]) + " GROUP BY type, phrase"


QUESTIONS = [
    (-1, "Tom has 3 apples and buys 2 more. How many apples does he have now?"),
    (-2, "If a server handles 1,200 requests and removes 15% of them, how many requests remain?"),
    (-3, "如果有三个苹果，卖掉1个，还剩多少个苹果？"),
    (-4, "Can command injection bypass 2 files when not given 2 users?"),
]


def _questions(spark, d):
    """Literal questions, benchmark items and documents; origin tells their ids apart."""
    return literal(spark, QUESTIONS, "item_id long, text string").withColumn("origin", F.lit("question")).unionByName(all_texts(spark, d))


def span_candidates(spark, d):
    return _questions(spark, d).select("origin", "item_id", F.inline(S.candidates(F.col("text"))))


def span_units(spark, d):
    """Units by scope and group type."""
    units = S.with_units(_questions(spark, d), "text").select(F.explode("units").alias("u"))
    return units.groupBy("u.unit_scope", "u.group_type").agg(F.count(F.lit(1)).alias("units"), F.sum(F.size("u.span_ids")).cast("long").alias("spans"))


def ablation_status(spark, d):
    units = S.with_units(_questions(spark, d), "text").select("origin", "item_id", "text", F.explode("units").alias("unit"))
    return S.ablations(units, "text", "unit").groupBy("kind", "status").agg(F.count(F.lit(1)).alias("rows"))


def masked_numbers(spark, d):
    """Every number of every document masked, by splicing; counts and a checksum of the result."""
    docs = table(spark, d, "documents")
    masked = X.masked(F.col("text"), X.matches(F.col("text"), NUMBER))
    return docs.select("doc_id", F.length(masked).cast("long").alias("chars"), F.md5(masked.cast("binary")).alias("digest"))


MASKED_NUMBERS = rf"SELECT doc_id, length(m) AS chars, md5(m) AS digest FROM (SELECT doc_id, regexp_replace(text, '{NUMBER}', '[MASK]', 'g') AS m FROM documents)"

def normal_text_duplicates(spark, d):
    docs = table(spark, d, "documents").select(X.normal(F.col("text")).alias("t"))
    return docs.groupBy("t").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").groupBy("copies").agg(F.count(F.lit(1)).alias("texts"))


NORMAL_TEXT_DUPLICATES = r"SELECT copies, count(*) AS texts FROM (SELECT count(*) AS copies FROM (SELECT lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents) GROUP BY t HAVING count(*) > 1) GROUP BY copies"

def degeneration_flags(spark, d):
    """Degeneration rules over the turns of conversations, and list-shaped turns."""
    c = table(spark, d, "conversations")
    rules = X.degeneration(F.col("text"), X.option_answer(F.col("text"), list("ABCD"))["label"])
    return c.select("role", F.explode_outer(rules).alias("rule"), X.list_like(F.col("text")).alias("list_like")).groupBy("role", "rule", "list_like").agg(F.count(F.lit(1)).alias("turns"))


def language_histogram(spark, d):
    docs = table(spark, d, "documents").select(X.language(F.col("text")).alias("language"))
    more = literal(spark, [("有三个苹果",), ("three apples",), ("混合 mixed",)], "t string").select(X.language(F.col("t")).alias("language"))
    return docs.unionByName(more).groupBy("language").agg(F.count(F.lit(1)).alias("texts"))


LANGUAGE_HISTOGRAM = "SELECT language, count(*) AS texts FROM (SELECT CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM documents UNION ALL SELECT unnest(['zh', 'en', 'zh'])) GROUP BY language"


def stable_choice(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.choice_index(F.col("c_custkey").cast("string"), 17, 7).cast("long").alias("choice"))


STABLE_CHOICE = "SELECT c_custkey, CAST(list_reduce(list_prepend(0, list_transform(string_split(sha1('17:' || c_custkey), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS INTEGER))), lambda s, x: (s * 16 + x) % 7) AS BIGINT) AS choice FROM customer"


def text_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.hashed(X.normal(F.col("text")), 16).alias("key"), X.hashed_int(F.col("text")).alias("seed"))


TEXT_HASHES = r"SELECT doc_id, substr(sha256(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'))), 1, 16) AS key, CAST(('0x' || substr(sha256(text), 1, 8))::BIGINT AS BIGINT) AS seed FROM documents"


def token_counts(spark, d):
    """Tokens with offsets over the turns of conversations."""
    t = table(spark, d, "conversations").select("role", F.inline(X.tokens(F.col("text"))))
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("tokens"), F.sum("end").cast("long").alias("ends"), F.sum(X.token_id(F.col("text"))).cast("long").alias("ids"))


TOKEN_COUNTS = r"""
WITH c AS (SELECT role, text, row_number() OVER () AS r FROM conversations WHERE text <> ''), x AS (SELECT role, r, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS i FROM c),
k AS (SELECT *, regexp_matches(ch, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]') AS w, regexp_matches(ch, '[\s\p{Z}]') AS s FROM x),
t AS (SELECT *, NOT s AND NOT (w AND coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), FALSE)) AS starts FROM k),
g AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS n FROM t),
o AS (SELECT role, r, n, max(i) AS e, (sum(i * unicode(ch)) - (min(i) - 1) * sum(unicode(ch))) % 100000 + 1 AS id FROM g WHERE NOT s GROUP BY ALL)
SELECT role, count(*) AS tokens, CAST(sum(e) AS BIGINT) AS ends, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY role
"""


_ASKED = """concat(CASE o_orderkey % 4 WHEN 0 THEN 'If Ann buys ' WHEN 1 THEN 'Tom sold ' WHEN 2 THEN 'After lunch Mary gave ' ELSE 'A baker never lost ' END, o_orderkey % 90 + 2, CASE o_custkey % 3 WHEN 0 THEN ' red apples each' WHEN 1 THEN ' miles per day' ELSE ' books' END,
  ' and ', o_custkey % 50, '% more than twelve friends, ', CASE o_orderkey % 3 WHEN 0 THEN 'How many are left?' WHEN 1 THEN 'How much did Tom spend?' ELSE 'What is the total for 1,250 cards at $3.50?' END)"""


def span_families(spark, d):
    """Spans of questions by family, thinned where they overlap: how many of each text, with their places, groups and parents."""
    asked = table(spark, d, "orders").select("o_orderkey", F.expr(_ASKED).alias("question"))
    rows = S.families(asked, "o_orderkey", "question")
    return rows.groupBy("type", "text").agg(F.count(F.lit(1)).alias("spans"), F.sum("start").cast("long").alias("starts"), F.count("overlap_group").alias("grouped"), F.count("parent").alias("inside"))


def word_statistics(spark, d):
    docs = table(spark, d, "documents")
    n = F.regexp_count("text", F.lit(r"\S+"))
    return A.distribution(docs.withColumn("n", n), F.col("n"), ["lang"])


WORD_STATISTICS = r"SELECT lang, count(n) AS n, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max, avg(n) AS mean, CAST(median(n) AS DOUBLE) AS median FROM (SELECT lang, len(regexp_extract_all(text, '\S+')) AS n FROM documents) GROUP BY lang"

QUERIES = {
    "number_spans": (number_spans, NUMBER_SPANS), "lexicon_counts": (lexicon_counts, LEXICON_COUNTS), "span_candidates": (span_candidates, None), "span_units": (span_units, None), "span_families": (span_families, None), "ablation_status": (ablation_status, None),
    "masked_numbers": (masked_numbers, MASKED_NUMBERS), "normal_text_duplicates": (normal_text_duplicates, NORMAL_TEXT_DUPLICATES),
    "degeneration_flags": (degeneration_flags, None), "language_histogram": (language_histogram, LANGUAGE_HISTOGRAM),
    "stable_choice": (stable_choice, STABLE_CHOICE), "text_hashes": (text_hashes, TEXT_HASHES), "token_counts": (token_counts, TOKEN_COUNTS), "word_statistics": (word_statistics, WORD_STATISTICS),
}
