"""Queries over relations: joins, differences, groups, ranks, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import contracts as K
from ..operators import joins as J
from ..operators import ranking as G
from ..operators import sampling as P
from .base import SCORED, scored_documents, table


def strict_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return J.strict_join(labels, J.kept(docs, labels, ["doc_id"]), ["doc_id"], one_to_one=True).groupBy("source", "quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").cast("long").alias("chars"))


STRICT_JOIN = "SELECT source, quality, toxic, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL"


def unlabelled(spark, d):
    return J.missing(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


UNLABELLED = "SELECT lang, count(*) AS docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"


def customers_with_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.kept(table(spark, d, "customer"), o, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


CUSTOMERS_WITH_ORDERS = "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment"


def key_differences(spark, d):
    a = table(spark, d, "documents").select("doc_id")
    b = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return J.unmatched(a, b, ["doc_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("keys"), F.sum("doc_id").cast("long").alias("total"))


KEY_DIFFERENCES = "WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id + 5 AS doc_id FROM labels) SELECT side, count(*) AS keys, CAST(sum(doc_id) AS BIGINT) AS total FROM (SELECT 'left' AS side, * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT FROM a)) GROUP BY side"


def transitions(spark, d):
    """From each user's first event type to the last."""
    e = table(spark, d, "events")
    first = J.one_per_key(e.select("user_id", "event_type", "event_id"), ["user_id"], [F.col("event_id")])
    last = J.one_per_key(e.select("user_id", "event_type", "event_id"), ["user_id"], [-F.col("event_id")])
    return J.transitions(first, last, ["user_id"], "event_type")


TRANSITIONS = "WITH t AS (SELECT user_id, min_by(event_type, event_id) AS a, max_by(event_type, event_id) AS b FROM events GROUP BY user_id) SELECT a || ' -> ' || b AS transition, count(*) AS rows FROM t GROUP BY 1"


def version_diff(spark, d):
    """Orders against a copy in which some changed, went or came."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus")))
    new = new.unionByName(o.where("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    return J.version_diff(o, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).groupBy("status", F.array_join("changed", ",").alias("changed")).agg(F.count(F.lit(1)).alias("rows"))


VERSION_DIFF = """
WITH n AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 = 1
), j AS (SELECT o.o_orderkey AS a, n.o_orderkey AS b, o.o_orderstatus <> n.s AS ds, o.o_totalprice <> n.p AS dp FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN ds OR dp THEN 'changed' ELSE 'same' END AS status,
       CASE WHEN ds AND dp THEN 'o_orderstatus,o_totalprice' WHEN ds THEN 'o_orderstatus' WHEN dp THEN 'o_totalprice' ELSE '' END AS changed, count(*) AS rows
FROM j GROUP BY ALL
"""


def filled_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("quality"))
    return J.filled_from(docs, table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"]).groupBy("lang", *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("quality", "toxic")]).agg(F.count(F.lit(1)).alias("docs"))


FILLED_LABELS = "SELECT lang, coalesce(CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE l.quality END AS VARCHAR), 'none') AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'none') AS toxic, count(*) AS docs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"


def win_rates(spark, d):
    return J.win_rate(scored_documents(spark, d), ["source"], F.col("toxic") == 1, "score")


WIN_RATES = f"""
WITH s AS {SCORED}, w AS (SELECT a.source, count(*) AS n, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS r FROM s a JOIN s b ON a.source = b.source AND a.toxic = 1 AND b.toxic = 0 GROUP BY a.source)
SELECT g.source, CAST(coalesce(w.n, 0) AS BIGINT) AS pairs, w.r AS win_rate FROM (SELECT DISTINCT source FROM s) g LEFT JOIN w USING (source)
"""


def concordance(spark, d):
    rows = scored_documents(spark, d).withColumn("level", F.col("quality") + 2 * F.col("toxic"))
    return G.concordance(rows, ["lang"], "score", "level")


CONCORDANCE = f"WITH s AS (SELECT *, quality + 2 * toxic AS level FROM {SCORED}) SELECT a.lang, count(*) AS pairs, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS concordance FROM s a JOIN s b ON a.lang = b.lang AND a.level > b.level GROUP BY a.lang"


def interval_overlaps(spark, d):
    """Intervals of events of one user that overlap, each made of an event's id and value."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.floor(F.coalesce("value", F.lit(0.0)) * 20) + 1).alias("end"))
    met = J.overlaps(e, e, ["user_id"], width=20000).where("event_id < r_event_id")
    return met.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


INTERVAL_OVERLAPS = 'WITH e AS (SELECT user_id, event_id, event_id * 10 AS s, event_id * 10 + CAST(floor(coalesce(value, 0) * 20) AS BIGINT) + 1 AS e FROM events) SELECT a.user_id, count(*) AS pairs FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e GROUP BY a.user_id'


def first_purchase_and_error(spark, d):
    return J.first_pairs(table(spark, d, "events"), ["user_id"], "event_type", "purchase", "error", "event_id")


FIRST_PURCHASE_AND_ERROR = "SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first_left, min(event_id) FILTER (event_type = 'error') AS first_right FROM events GROUP BY user_id HAVING first_left IS NOT NULL AND first_right IS NOT NULL"


def paired_deltas(spark, d):
    return J.paired(table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("q")), ["l_suppkey"], "l_returnflag", "R", "N", "q").select("l_suppkey", F.round("delta", 6).alias("delta"))


PAIRED_DELTAS = "WITH q AS (SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY ALL) SELECT a.l_suppkey, round(a.q - b.q, 6) AS delta FROM q a JOIN q b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N'"


def vote_consistency(spark, d):
    return A.consistency(table(spark, d, "events"), ["user_id"], "event_type", F.col("event_id")).select("user_id", "values", "mode", "mode_rows", F.round("consistency", 9).alias("consistency"))


VOTE_CONSISTENCY = 'WITH c AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, CAST(sum(c) AS BIGINT) AS "values", (arg_min(event_type, (-c, f))) AS mode, max(c) AS mode_rows, round(max(c) / sum(c), 9) AS consistency FROM c GROUP BY user_id'

TYPES = ["click", "view", "purchase", "error"]


def majority_labels(spark, d):
    return A.label_votes(table(spark, d, "events"), ["user_id"], "event_type", TYPES).select("user_id", "samples", "parsed", "failed", "majority", F.col("votes")["click"].alias("clicks"))


MAJORITY_LABELS = "WITH v AS (SELECT user_id, count(*) AS samples, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id) SELECT user_id, samples, c + v + p + e AS parsed, samples - c - v - p - e AS failed, CASE WHEN c + v + p + e = 0 THEN NULL WHEN c >= v AND c >= p AND c >= e THEN 'click' WHEN v >= p AND v >= e THEN 'view' WHEN p >= e THEN 'purchase' ELSE 'error' END AS majority, c AS clicks FROM v"


def grouping_rates(spark, d):
    e = table(spark, d, "events")
    out = A.rates(e.withColumn("even", (F.col("user_id") % 2).cast("string")), [[], ["event_type"], ["event_type", "even"]], {"high": F.col("value") > 50, "missing": F.col("value").isNull()})
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("even", F.lit("all")).alias("even"), "rows", F.round("high", 9).alias("high"), F.round("missing", 9).alias("missing"))


GROUPING_RATES = "SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(even AS VARCHAR), 'all') AS even, count(*) AS rows, round(count(*) FILTER (value > 50) / count(*), 9) AS high, round(count(*) FILTER (value IS NULL) / count(*), 9) AS missing FROM (SELECT *, user_id % 2 AS even FROM events) GROUP BY GROUPING SETS ((), (event_type), (event_type, even))"


def confusion_metrics(spark, d):
    rows = scored_documents(spark, d).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    out = A.class_metrics(rows, "quality", "predicted")
    return out.select("label", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


CONFUSION_METRICS = f"""
WITH s AS (SELECT quality AS g, CAST(score > 0.5 AS INTEGER) AS p FROM {SCORED}), c AS (SELECT l, (SELECT count(*) FROM s WHERE g = l) AS support, (SELECT count(*) FROM s WHERE p = l) AS predicted, (SELECT count(*) FROM s WHERE g = l AND p = l) AS hits FROM (SELECT 0 AS l UNION ALL SELECT 1))
SELECT CAST(l AS VARCHAR) AS label, support, predicted, hits, round(coalesce(hits / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(hits / nullif(support, 0), 0), 9) AS recall, round(coalesce(2.0 * hits / nullif(support + predicted, 0), 0), 9) AS f1 FROM c
"""


def overall_metrics(spark, d):
    rows = scored_documents(spark, d).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return A.overall_metrics(rows, "quality", "predicted").select("rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "majority_share")])


OVERALL_METRICS = f"""
WITH s AS (SELECT quality AS g, CAST(score > 0.5 AS INTEGER) AS p FROM {SCORED}), c AS (SELECT l, (SELECT count(*) FROM s WHERE g = l) AS n, (SELECT count(*) FROM s WHERE p = l) AS q, (SELECT count(*) FROM s WHERE g = l AND p = l) AS h FROM (SELECT 0 AS l UNION ALL SELECT 1))
SELECT CAST(sum(n) AS BIGINT) AS rows, round(sum(h) / sum(n), 9) AS accuracy, round(avg(2.0 * h / (n + q)), 9) AS macro_f1, round(avg(h / n), 9) AS balanced_accuracy, round(max(n) / sum(n), 9) AS majority_share FROM c
"""


def calibration(spark, d):
    out = A.calibration(scored_documents(spark, d), "score", "toxic", "doc_id", 7)
    return out.select("part", "rows", *[F.round(c, 9).alias(c) for c in ("mean_score", "rate", "gap")])


CALIBRATION = f"SELECT CAST(part AS INTEGER) AS part, count(*) AS rows, round(avg(score), 9) AS mean_score, round(avg(toxic), 9) AS rate, round(abs(avg(score) - avg(toxic)), 9) AS gap FROM (SELECT *, ntile(7) OVER (ORDER BY score DESC, doc_id) AS part FROM {SCORED}) GROUP BY part"


def risk_coverage(spark, d):
    out = G.risk_coverage(scored_documents(spark, d), "score", "doc_id", F.col("quality") == 0, [0.1, 0.25, 0.5, 1.0])
    return out.select("coverage", "rows", F.round("risk", 9).alias("risk"))


RISK_COVERAGE = f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS r, count(*) OVER () AS n FROM {SCORED}) SELECT c.coverage, count(*) AS rows, round(avg(CAST(quality = 0 AS INTEGER)), 9) AS risk FROM r, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS coverage) c WHERE r <= greatest(1, round_even(n * coverage, 0)) GROUP BY c.coverage"


def functional_dependency(spark, d):
    return A.dependency(table(spark, d, "documents"), "source", "lang")


FUNCTIONAL_DEPENDENCY = "SELECT source AS value, count(DISTINCT lang) AS dependents FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1"


def band_separation(spark, d):
    rows = scored_documents(spark, d).withColumn("band", F.floor(F.col("score") * 4).cast("long"))
    return A.band_separation(rows, "band", "score")


BAND_SEPARATION = f"WITH b AS (SELECT CAST(floor(score * 4) AS BIGINT) AS band, min(score) AS low, max(score) AS high FROM {SCORED} GROUP BY 1), l AS (SELECT *, lead(low) OVER (ORDER BY band) AS next_low FROM b) SELECT band, low, high, next_low, next_low IS NULL OR high <= next_low AS separated FROM l"


def minmax_by_order(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.minmax("l_quantity", ["l_orderkey"], 0.5).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.round("m", 9).alias("scaled"))


MINMAX_BY_ORDER = "SELECT l_orderkey, l_linenumber, round(CASE WHEN min(l_quantity) OVER w = max(l_quantity) OVER w THEN 0.5 ELSE (l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) END, 9) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)"


def global_scaling(spark, d):
    z = G.zscored(G.scaled(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_totalprice").alias("u")), ["u"]), ["p"])
    return z.select("o_orderkey", F.round("u", 6).alias("scaled"), F.round("p_z", 6).alias("z"))


GLOBAL_SCALING = "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS scaled, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders"


def rank_policies(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.ranks(rows, ["l_suppkey"], "l_quantity", "k").select("k", F.col("rank").cast("long").alias("rank"), "average_rank", F.col("row_rank").cast("long").alias("row_rank"))


RANK_POLICIES = "SELECT l_orderkey * 10 + l_linenumber AS k, rank() OVER w AS rank, rank() OVER w + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS average_rank, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS row_rank FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity DESC)"


def median_gate(spark, d):
    out = G.gated(table(spark, d, "documents").select("doc_id", "source", "n_chars", F.col("n_chars").cast("double").alias("score")), ["source"], "n_chars", "score")
    return out.groupBy("source").agg(F.round(F.sum("gated"), 4).alias("mass"), F.count_if(F.col("gated") < F.col("score")).alias("gated_docs"))


MEDIAN_GATE = "WITH m AS (SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS m FROM documents GROUP BY source) SELECT source, round(sum(CASE WHEN n_chars < m THEN n_chars * 0.02::DOUBLE ELSE n_chars END), 4) AS mass, count(*) FILTER (n_chars < m AND n_chars > 0) AS gated_docs FROM documents JOIN m USING (source) GROUP BY source"


def average_precision(spark, d):
    return G.average_precision(scored_documents(spark, d), "score", "doc_id", "quality").select(F.round("auprc", 9).alias("auprc"))


AVERAGE_PRECISION = f"WITH r AS (SELECT quality, row_number() OVER w AS r, sum(quality) OVER w AS tp FROM {SCORED} WINDOW w AS (ORDER BY score DESC, doc_id)) SELECT round(avg(tp / r), 9) AS auprc FROM r WHERE quality = 1"


def topk_hits(spark, d):
    out = G.hit_at(scored_documents(spark, d), ["source"], [F.desc("score"), F.asc("doc_id")], F.col("toxic") == 1, [1, 3, 5, 10])
    return out.select("k", "groups", "hits", F.round("rate", 9).alias("rate"))


TOPK_HITS = f"WITH r AS (SELECT source, toxic, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM {SCORED}), f AS (SELECT source, min(r) AS f FROM r WHERE toxic = 1 GROUP BY source) SELECT CAST(k AS INTEGER) AS k, count(*) AS groups, count(*) FILTER (f <= k) AS hits, round(count(*) FILTER (f <= k) / count(*), 9) AS rate FROM f, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k"


def quota_sample(spark, d):
    return P.quota(table(spark, d, "documents"), ["source", "lang"], "doc_id", 3, seed=5).select("source", "lang", "doc_id")


QUOTA_SAMPLE = "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY sha256('5:' || doc_id), doc_id) <= 3"


def budget_precision(spark, d):
    return G.budget(scored_documents(spark, d), "score", "doc_id", F.col("quality") == 1, 0.15).select("k", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


BUDGET_PRECISION = f"WITH r AS (SELECT quality, row_number() OVER (ORDER BY score DESC, doc_id) AS r, greatest(1, CAST(round_even(count(*) OVER () * 0.15, 0) AS BIGINT)) AS k, sum(quality) OVER () AS a FROM {SCORED}) SELECT k, CAST(sum(quality) AS BIGINT) AS hits, round(sum(quality) / k, 9) AS precision, round(sum(quality) / max(a), 9) AS recall, round(2.0 * sum(quality) / (k + max(a)), 9) AS f1 FROM r WHERE r <= k GROUP BY k"


def group_split(spark, d):
    return P.group_split(table(spark, d, "orders"), "o_custkey", {"train": 0.7, "dev": 0.15, "test": 0.15}, seed=42).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("groups"))


GROUP_SPLIT = "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('42:' || o_custkey), o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)), s AS (SELECT o_custkey, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM g) SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS groups FROM orders JOIN s USING (o_custkey) GROUP BY split"


def group_folds(spark, d):
    return P.folds(table(spark, d, "documents"), "source", 5, seed=1).groupBy("fold").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"))


GROUP_FOLDS = "WITH g AS (SELECT source, CAST((row_number() OVER (ORDER BY sha256('1:' || source), source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)) SELECT fold, count(*) AS docs, count(DISTINCT source) AS sources FROM documents JOIN g USING (source) GROUP BY fold"


def contract_counts(spark, d):
    docs = table(spark, d, "documents")
    rules = {"text_filled": K.filled(F.col("text")), "lang_known": K.one_of(F.col("lang"), ["en", "de", "fr"]), "short": K.between(F.col("n_chars"), 1, 5000), "length": F.col("n_chars") == F.length("text")}
    return K.violation_counts(docs, rules)


CONTRACT_COUNTS = "SELECT 'text_filled' AS rule, count(*) FILTER (length(trim(text)) = 0) AS rows FROM documents UNION ALL SELECT 'lang_known', count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) FROM documents UNION ALL SELECT 'short', count(*) FILTER (n_chars < 1 OR n_chars > 5000) FROM documents UNION ALL SELECT 'length', count(*) FILTER (n_chars <> length(text)) FROM documents"


def feature_completeness(spark, d):
    l = table(spark, d, "lineitem").withColumn("constant", F.lit(0.0))
    return K.completeness(l, ["l_quantity", "l_discount", "l_tax", "constant"])


FEATURE_COMPLETENESS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({e} IS NULL) AS missing, count(*) FILTER ({e} <> 0) AS nonzero, count(DISTINCT {e}) AS distinct, count(*) FILTER ({e} <> 0) = 0 OR count(DISTINCT {e}) <= 1 AS silent FROM lineitem" for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("constant", "0.0"))).replace("AS distinct", 'AS "distinct"')


def duplicate_keys(spark, d):
    return K.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"]).groupBy("rows").agg(F.count(F.lit(1)).alias("keys"))


DUPLICATE_KEYS = "SELECT rows, count(*) AS keys FROM (SELECT count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1) GROUP BY rows"


def inconsistent_sources(spark, d):
    return K.inconsistent_groups(table(spark, d, "documents"), ["source"], ["lang"])


INCONSISTENT_SOURCES = "SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1"


def value_shares(spark, d):
    return A.position_bias(table(spark, d, "orders"), "o_orderpriority").select("value", "rows", F.round("share", 9).alias("share"), "severe")


VALUE_SHARES = "SELECT o_orderpriority AS value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(*) / sum(count(*)) OVER () > 0.4 AS severe FROM orders GROUP BY 1"


def stage_histograms(spark, d):
    return A.histograms(table(spark, d, "documents"), ["lang", "source"])


STAGE_HISTOGRAMS = "SELECT 'lang' AS field, lang AS value, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"

def off_class_mass(spark, d):
    return A.off_class_share(scored_documents(spark, d), ["lang"], "score", F.col("quality") == 0).select("lang", F.round("off_share", 9).alias("off_share"))


OFF_CLASS_MASS = f"SELECT lang, round(coalesce(sum(score) FILTER (quality = 0), 0) / sum(score), 9) AS off_share FROM {SCORED} GROUP BY lang"


def revenue_by_nation(spark, d):
    """Revenue of shipped items by nation and year: scan, filter, three joins and one aggregate."""
    l = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.year("l_shipdate").alias("year"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "year").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count(F.lit(1)).alias("items"))


REVENUE_BY_NATION = "SELECT n_name, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "strict_join", "unlabelled", "customers_with_orders", "key_differences", "transitions", "version_diff", "filled_labels", "win_rates", "concordance", "interval_overlaps", "first_purchase_and_error",
    "paired_deltas", "vote_consistency", "majority_labels", "grouping_rates", "confusion_metrics", "overall_metrics", "calibration", "risk_coverage", "functional_dependency", "band_separation", "minmax_by_order",
    "global_scaling", "rank_policies", "median_gate", "average_precision", "topk_hits", "quota_sample", "budget_precision", "group_split", "group_folds", "contract_counts", "feature_completeness", "duplicate_keys",
    "inconsistent_sources", "value_shares", "stage_histograms", "off_class_mass", "revenue_by_nation",
)}
