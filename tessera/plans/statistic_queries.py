"""Queries over scores, vectors and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ml as M
from ..operators import sampling as P
from ..operators import stats as S
from .base import SCORED, all_texts, scored_documents, table

ROUNDS = 50


def auroc(spark, d):
    return S.auroc(scored_documents(spark, d), "score", "quality").select("positives", "negatives", F.round("auroc", 9).alias("auroc"))


PAIR_AUC = "avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)"
AUROC = f"WITH s AS {SCORED} SELECT (SELECT count(*) FROM s WHERE quality = 1) AS positives, (SELECT count(*) FROM s WHERE quality = 0) AS negatives, round({PAIR_AUC}, 9) AS auroc FROM s a JOIN s b ON a.quality = 1 AND b.quality = 0"


def auroc_by_source(spark, d):
    return S.auroc(scored_documents(spark, d), "score", "toxic", ["source"]).select("source", "positives", "negatives", F.round("auroc", 9).alias("auroc"))


AUROC_BY_SOURCE = f"WITH s AS {SCORED}, n AS (SELECT source, CAST(sum(toxic) AS BIGINT) AS positives, CAST(sum(1 - toxic) AS BIGINT) AS negatives FROM s GROUP BY source), p AS (SELECT a.source, round({PAIR_AUC}, 9) AS auroc FROM s a JOIN s b ON a.source = b.source AND a.toxic = 1 AND b.toxic = 0 GROUP BY a.source) SELECT n.source, positives, negatives, auroc FROM n LEFT JOIN p USING (source)"


def spearman(spark, d):
    return S.spearman(scored_documents(spark, d), "score", "other", ["lang"]).select("lang", "rows", F.round("spearman", 7).alias("spearman"))


SPEARMAN = f"WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY other) + (count(*) OVER (PARTITION BY lang, other) - 1) / 2.0 AS y FROM {SCORED}) SELECT lang, count(*) AS rows, round(corr(x, y), 7) AS spearman FROM r GROUP BY lang"


def _times(group: str, seed: int) -> str:
    """How often a round draws a group, in SQL."""
    u = f"CAST(('0x' || substr(sha256('{seed}:' || b.round || ':' || {group}), 1, 8)) AS BIGINT)"
    ends = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923275]
    return "CASE " + " ".join(f"WHEN {u} < {e} THEN {k}" for k, e in enumerate(ends)) + f" ELSE {len(ends)} END"


ROUND_TABLE = f"(SELECT CAST(unnest(range(0, {ROUNDS})) AS INTEGER) AS round) b"


def bootstrap_means(spark, d):
    return S.bootstrap_mean(scored_documents(spark, d), "source", "score", ROUNDS, seed=3).select("round", F.round("mean", 9).alias("mean"))


BOOTSTRAP_MEANS = f"WITH g AS (SELECT source, sum(score) AS s, count(*) AS n FROM {SCORED} GROUP BY source) SELECT round, round(sum(s * t) / sum(n * t), 9) AS mean FROM (SELECT b.round, g.s, g.n, {_times('g.source', 3)} AS t FROM g, {ROUND_TABLE}) WHERE t > 0 GROUP BY round"


def bootstrap_interval(spark, d):
    out = S.interval(S.bootstrap_mean(scored_documents(spark, d), "source", "score", ROUNDS, seed=3), "mean")
    return out.select("rounds", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


BOOTSTRAP_INTERVAL = f"SELECT count(mean) AS rounds, round(avg(mean), 8) AS mean, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM (WITH g AS (SELECT source, sum(score) AS s, count(*) AS n FROM {SCORED} GROUP BY source) SELECT round, sum(s * t) / sum(n * t) AS mean FROM (SELECT b.round, g.s, g.n, {_times('g.source', 3)} AS t FROM g, {ROUND_TABLE}) WHERE t > 0 GROUP BY round)"


def paired_bootstrap(spark, d):
    out = S.bootstrap_auroc(scored_documents(spark, d), "source", "quality", ["score", "other"], 20, seed=9)
    return out.select("round", F.round("score", 9).alias("score"), F.round("other", 9).alias("other"))


def _boot_auc(score: str) -> str:
    return f"SELECT round, sum(a_t * b_t * CASE WHEN a_s > b_s THEN 1.0 WHEN a_s = b_s THEN 0.5 ELSE 0 END) / sum(a_t * b_t) AS v FROM (SELECT p.round, p.t AS a_t, q.t AS b_t, p.{score} AS a_s, q.{score} AS b_s FROM w p JOIN w q ON p.round = q.round AND p.quality = 1 AND q.quality = 0) GROUP BY round"


PAIRED_BOOTSTRAP = f"WITH s AS {SCORED}, w AS (SELECT * FROM (SELECT b.round, s.quality, s.score, s.other, {_times('s.source', 9)} AS t FROM s, {ROUND_TABLE.replace(str(ROUNDS), '20')}) WHERE t > 0), x AS ({_boot_auc('score')}), y AS ({_boot_auc('other')}) SELECT x.round, round(x.v, 9) AS score, round(y.v, 9) AS other FROM x JOIN y USING (round)"


_RAISED = "list_transform(list_transform(embedding{0}, lambda v: v::DOUBLE), lambda v: exp(v - list_max(list_transform(embedding{0}, lambda u: u::DOUBLE))))"


def softmax_entropy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.softmax(F.col("embedding")).alias("p"))
    return e.select("vec_id", F.round(V.entropy(F.col("p")), 4).alias("entropy"), F.round(V.top_two_margin(F.col("p")), 4).alias("margin"))


SOFTMAX_ENTROPY = f"WITH x AS (SELECT vec_id, {_RAISED.format('')} AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x) SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 4) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 4) AS margin FROM p"


def divergences(spark, d):
    """Between the two halves of each vector."""
    e = table(spark, d, "embeddings").select("vec_id", V.softmax(F.slice("embedding", 1, 32)).alias("p"), V.softmax(F.slice("embedding", 33, 32)).alias("q"))
    return e.select("vec_id", F.round(V.kl(F.col("p"), F.col("q")), 5).alias("kl"), F.round(V.js(F.col("p"), F.col("q")), 5).alias("js"))


_KL = lambda a, b: f"list_sum(list_transform(z, lambda v: {a} * ln({a} / {b})))"
DIVERGENCES = f"WITH x AS (SELECT vec_id, {_RAISED.format('[1:32]')} AS a, {_RAISED.format('[33:64]')} AS b FROM embeddings), p AS (SELECT vec_id, list_zip(list_transform(a, lambda v: v / list_sum(a)), list_transform(b, lambda v: v / list_sum(b))) AS z FROM x) SELECT vec_id, round({_KL('v[1]', 'v[2]')}, 5) AS kl, round(0.5 * {_KL('v[1]', '((v[1] + v[2]) / 2)')} + 0.5 * {_KL('v[2]', '((v[1] + v[2]) / 2)')}, 5) AS js FROM p"


def cosines(spark, d):
    """Cosine and distance of each vector to the mean of its label."""
    e = table(spark, d, "embeddings")
    means = e.groupBy("label").agg(*V.mean_vector(F.col("embedding"), 64))
    means = means.select("label", F.array(*[f"m{i}" for i in range(64)]).alias("mean"))
    out = e.join(means, "label")
    return out.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"), F.round(V.distance(F.col("embedding"), F.col("mean")), 6).alias("distance"))


COSINES = "WITH m AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) AS cosine, round(list_distance(embedding::DOUBLE[], m), 6) AS distance FROM embeddings JOIN m USING (label)"


def layer_summaries(spark, d):
    s = V.layer_summary(F.col("embedding"))
    e = table(spark, d, "embeddings").select("vec_id", s.alias("s"), V.slope(F.col("embedding")).alias("slope"))
    return e.select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("mean", "max", "min", "first", "last", "rise")], F.round("slope", 8).alias("slope"))


LAYER_SUMMARIES = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding AS f FROM embeddings) SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_max(v), 6) AS max, round(list_min(v), 6) AS min, round(v[1], 6) AS first, round(v[-1], 6) AS last, round((f[-1] - f[1])::DOUBLE, 6) AS rise, round(list_sum(list_transform(list_zip(v, range(0, 64)), lambda z: (z[2] - 31.5) * z[1])) / list_sum(list_transform(range(0, 64), lambda i: (i - 31.5) * (i - 31.5))), 8) AS slope FROM e"


def leave_one_out(spark, d):
    rows = S.loo_mean(scored_documents(spark, d), ["source"], "score")
    return rows.select("doc_id", F.round("loo_mean", 9).alias("loo_mean"))


LEAVE_ONE_OUT = f"SELECT doc_id, CASE WHEN count(*) OVER w > 1 THEN round((sum(score) OVER w - score) / (count(*) OVER w - 1), 9) END AS loo_mean FROM {SCORED} WINDOW w AS (PARTITION BY source)"


def feature_usefulness(spark, d):
    rows = scored_documents(spark, d).select("quality", F.create_map(F.lit("score"), F.col("score"), F.lit("other"), F.col("other")).alias("features"))
    return S.usefulness(rows, "features", "quality").select("feature", "rows", F.round("spearman", 7).alias("spearman"))


FEATURE_USEFULNESS = f"WITH s AS (SELECT 'score' AS feature, score AS v, quality AS t FROM {SCORED} UNION ALL SELECT 'other', other, quality FROM {SCORED}), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS x, rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS y FROM s) SELECT feature, count(*) AS rows, round(corr(x, y), 7) AS spearman FROM r GROUP BY feature"


def tfidf_terms(spark, d):
    """Weight of every term of the benchmark items and documents, as one corpus."""
    texts = all_texts(spark, d).select(F.struct("origin", "item_id").alias("id"), "text")
    return M.tfidf(texts, "id", "text").select("id.origin", "id.item_id", "term", F.round("weight", 7).alias("weight"))


def ridge_predictions(spark, d):
    """Out-of-fold values of a ridge model over grouped folds."""
    rows = P.folds(M.scaled_block(scored_documents(spark, d), ["score", "other"]), "source", 4, seed=2)
    rows = rows.withColumns({"x0": F.col("block")[0], "x1": F.col("block")[1]})
    out = M.out_of_fold(rows, ["x0", "x1"], "quality", "fold", 4, fit=M.ridge, alpha=1.0)
    return out.select("doc_id", "fold", F.round("oof", 6).alias("oof"))


RIDGE_PREDICTIONS = f"""
WITH s AS (SELECT * FROM {SCORED}), m AS (SELECT avg(score) AS ms, stddev_pop(score) AS ss, avg(other) AS mo, stddev_pop(other) AS so FROM s),
g AS (SELECT source, CAST((row_number() OVER (ORDER BY sha256('2:' || source), source) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM s)),
r AS (SELECT doc_id, fold, (score - ms) / CASE WHEN ss < 1e-12 THEN 1.0 ELSE ss END / sqrt(2.0) AS x, (other - mo) / CASE WHEN so < 1e-12 THEN 1.0 ELSE so END / sqrt(2.0) AS z, quality::DOUBLE AS y FROM s JOIN g USING (source), m),
q AS (SELECT f, sum(x * x) + 1 AS a, sum(x * z) AS b, sum(z * z) + 1 AS c, sum(x) AS d, sum(z) AS e, count(*)::DOUBLE AS n, sum(x * y) AS t, sum(z * y) AS u, sum(y) AS v FROM r, (SELECT unnest([0, 1, 2, 3]) AS f) WHERE fold <> f GROUP BY f),
w AS (SELECT f, a * (c * n - e * e) - b * (b * n - e * d) + d * (b * e - c * d) AS det, t * (c * n - e * e) - b * (u * n - e * v) + d * (u * e - c * v) AS w0, a * (u * n - e * v) - t * (b * n - e * d) + d * (b * v - u * d) AS w1,
  a * (c * v - u * e) - b * (b * v - u * d) + t * (b * e - c * d) AS w2 FROM q)
SELECT doc_id, fold, round((w0 * x + w1 * z + w2) / det, 6) AS oof FROM r JOIN w ON f = fold
"""


def logistic_auroc(spark, d):
    """AUROC of out-of-fold logistic values, by fold."""
    rows = P.folds(scored_documents(spark, d), "source", 3, seed=2)
    out = M.out_of_fold(rows, ["score", "other"], "quality", "fold", 3, c=1.0, rounds=4)
    return S.auroc(out, "oof", "quality", ["fold"])


def uniform_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.hash_uniform(F.col("c_custkey"), 7).alias("u"))


UNIFORM_HASH = "SELECT c_custkey, CAST(('0x' || substr(sha256('7:' || c_custkey), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM customer"

QUERIES = {name: (globals()[name], globals().get(name.upper())) for name in (
    "auroc", "auroc_by_source", "spearman", "bootstrap_means", "bootstrap_interval", "paired_bootstrap", "softmax_entropy", "divergences", "cosines", "layer_summaries", "leave_one_out",
    "feature_usefulness", "tfidf_terms", "ridge_predictions", "logistic_auroc", "uniform_hash",
)}
