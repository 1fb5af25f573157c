"""Queries over scored spans: formulas, their rankings, and what is decided by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas as M
from ..operators import stats as S
from .base import SPANS, spans
from .statistic_queries import _times


def _rounded(df, *keys, digits: int = 9):
    """df with doubles rounded, other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


# ---- the formulas

_B = "surface * hidden"
_PRIORITY = f"""
p AS (SELECT *, row_number() OVER (ORDER BY attention) AS r_, count(*) OVER () AS n_ FROM {SPANS}),
m AS (SELECT attention AS med FROM p WHERE r_ = n_ // 2 + 1),
b AS (SELECT s.*, m.med, ({_B}) AS b6, min(({_B})) OVER w AS lo, max(({_B})) OVER w AS hi,
        row_number() OVER (PARTITION BY question_id, span_type = 'number' ORDER BY ({_B}) DESC, span_id) AS place
      FROM {SPANS} s, m WINDOW w AS (PARTITION BY question_id)),
f AS (SELECT question_id, span_id, span_type, status, bucket, unnest([
  {{'formula': 'A_current_priority', 'score': (current)}}, {{'formula': 'B_keyness_times_fragility', 'score': b6}},
  {{'formula': 'C_keyness_gate_then_fragility', 'score': (CASE WHEN surface >= 0.55 THEN hidden ELSE hidden * 0.25 END)}}, {{'formula': 'D_keyness_fragility_attention', 'score': ({_B} * (0.5 + attention))}},
  {{'formula': 'E_per_question_normalized_priority', 'score': (CASE WHEN hi = lo THEN 0.5 ELSE (b6 - lo) / (hi - lo) END)}},
  {{'formula': 'F_offpath_proxy_penalty', 'score': ({_B} * CASE WHEN span_type = 'number' AND attention < med THEN 0.75 ELSE 1.0 END)}},
  {{'formula': 'G_span_type_budget_cap', 'score': (b6 * CASE WHEN span_type <> 'number' OR place = 1 THEN 1.0 WHEN place = 2 THEN 0.7 ELSE 0.45 END)}},
  {{'formula': 'surface_rule_baseline', 'score': (surface)}}, {{'formula': 'hidden_pre_recovery_baseline', 'score': (hidden)}}, {{'formula': 'attention_pre_recovery_baseline', 'score': (attention)}},
  {{'formula': 'hidden_plus_attention_baseline', 'score': (fused)}},
  {{'formula': 'oracle_diagnostic_only', 'score': (CASE status WHEN 'on_solution_path_number' THEN 1.0 WHEN 'ambiguous_number' THEN 0.5 ELSE 0.0 END * (bucket / 3.0::DOUBLE))}}], recursive := true) FROM b)
"""


def priority_formulas(spark, d):
    """Sum, largest and number of distinct scores of each formula, over all spans."""
    rows = M.long(M.priority(spans(spark, d), digits=None))
    return _rounded(rows.groupBy("formula").agg(F.count(F.lit(1)).alias("spans"), F.sum("score").alias("total"), F.max("score").alias("largest"), F.count_if(F.col("score") > 0.5).alias("high")), digits=4)


PRIORITY_FORMULAS = f"WITH {_PRIORITY} SELECT formula, count(*) AS spans, round(sum(score), 4) AS total, round(max(score), 4) AS largest, count(*) FILTER (score > 0.5) AS high FROM f GROUP BY formula"


def budget_cap(spark, d):
    """The capped score of every span."""
    return _rounded(M.long(M.priority(spans(spark, d), digits=None)).where("formula = 'G_span_type_budget_cap'").select("span_id", "score"))


BUDGET_CAP = f"WITH {_PRIORITY} SELECT span_id, round(score, 9) AS score FROM f WHERE formula = 'G_span_type_budget_cap'"

_SEMANTIC = "CASE span_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.SEMANTIC_KEYNESS.items()) + " ELSE 0.35 END::DOUBLE"
_KEYS = ", ".join(f"'{k}'" for k in M.KEY_TYPES)
_BUDGET = f"""
a AS (SELECT *, (surface + {_SEMANTIC}) / 2.0::DOUBLE AS k, (hidden + attention) / 2.0::DOUBLE AS fr FROM {SPANS}),
e AS (SELECT *, k * fr AS e, min(k * fr) OVER w AS lo, max(k * fr) OVER w AS hi FROM a WINDOW w AS (PARTITION BY question_id)),
f AS (SELECT question_id, span_id, span_type, status, bucket, unnest([
  {{'formula': 'A_surface_only', 'score': surface}}, {{'formula': 'B_hidden_only', 'score': hidden}}, {{'formula': 'C_attention_only', 'score': attention}}, {{'formula': 'D_hidden_plus_attention', 'score': fr}},
  {{'formula': 'E_keyness_times_fragility', 'score': e}}, {{'formula': 'F_keyness_gate_then_fragility', 'score': CASE WHEN k >= 0.45 THEN fr ELSE 0.05::DOUBLE * fr END}},
  {{'formula': 'G_per_question_normalized_priority', 'score': CASE WHEN hi - lo > 1e-12 THEN (e - lo) / (hi - lo) ELSE 0.0::DOUBLE END}},
  {{'formula': 'H_span_type_budget_policy', 'score': e * (CASE WHEN span_type = 'object' THEN 0.55 WHEN span_type IN ('comparison', 'negation', 'condition') THEN 1.15 WHEN span_type IN ('number', 'number_unit', 'rate') THEN 0.96 ELSE 1.0 END)::DOUBLE}},
  {{'formula': 'I_oracle_diagnostic_upper_bound', 'score': (CASE WHEN status = 'on_solution_path_number' THEN 1.0 WHEN status = 'off_solution_path_number' THEN 0.0 WHEN span_type IN ({_KEYS}) THEN 0.75 ELSE 0.2 END)::DOUBLE * fr}}], recursive := true) FROM e)
"""


def budget_formulas(spark, d):
    rows = M.long(M.budget(spans(spark, d)))
    return _rounded(rows.groupBy("formula").agg(F.count(F.lit(1)).alias("spans"), F.sum("score").alias("total"), F.max("score").alias("largest")), digits=5)


BUDGET_FORMULAS = f"WITH {_BUDGET} SELECT formula, count(*) AS spans, round(sum(score), 5) AS total, round(max(score), 5) AS largest FROM f GROUP BY formula"


def _responses(spark, d):
    return M.responses(spans(spark, d).withColumns({"prompt": F.col("current"), "response": F.col("output")}))


_RESPONSES = f"""
q AS (SELECT *, list_sort(list(output) OVER w)[count(*) OVER w // 2 + 1] AS rm, list_sort(list(attention) OVER w)[count(*) OVER w // 2 + 1] AS am FROM {SPANS} WINDOW w AS (PARTITION BY question_id)),
f AS (SELECT question_id, span_id, span_type, status, bucket, unnest([
  {{'formula': 'A_surface', 'score': surface}}, {{'formula': 'B_attention_only', 'score': attention}}, {{'formula': 'C_prompt_final_output_only', 'score': current}}, {{'formula': 'D_response_position_output_only', 'score': output}},
  {{'formula': 'E_attention_x_prompt_final_output', 'score': attention * current}}, {{'formula': 'F_attention_x_response_position_output', 'score': attention * output}},
  {{'formula': 'G_response_output_gate_then_attention', 'score': CASE WHEN output >= rm THEN attention ELSE 0.02::DOUBLE * attention END}}, {{'formula': 'H_attention_gate_then_response_output', 'score': CASE WHEN attention >= am THEN output ELSE 0.02::DOUBLE * output END}},
  {{'formula': 'I_mean_attention_response_output', 'score': 0.5::DOUBLE * (attention + output)}}, {{'formula': 'J_max_attention_response_output', 'score': greatest(attention, output)}}, {{'formula': 'K_min_attention_response_output', 'score': least(attention, output)}}], recursive := true) FROM q)
"""


def response_formulas(spark, d):
    rows = M.long(_responses(spark, d))
    return _rounded(rows.groupBy("formula").agg(F.count(F.lit(1)).alias("spans"), F.sum("score").alias("total"), F.max("score").alias("largest")), digits=5)


RESPONSE_FORMULAS = f"WITH {_RESPONSES} SELECT formula, count(*) AS spans, round(sum(score), 5) AS total, round(max(score), 5) AS largest FROM f GROUP BY formula"

# ---- rankings

_TYPES = ["comparison", "negation", "condition", "operation", "question_target"]
_WIN = "CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END"


def _metrics(top_k: int = 3) -> str:
    """Ranking metrics of a table f (formula, question_id, span_id, span_type, status, bucket, score), in SQL."""
    key = f"(coalesce(status = 'on_solution_path_number', false) OR span_type IN ({_KEYS}))"
    share = lambda c, k: f"coalesce(count(*) FILTER ({c} <= {k}) / nullif(count({c}), 0)::DOUBLE, 0.0::DOUBLE)"
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY formula, question_id ORDER BY score DESC, span_id) AS rank FROM f),
g AS (SELECT formula, question_id, min(rank) FILTER {key} AS key, min(rank) FILTER (bucket = 3) AS b3, min(rank) FILTER (status = 'on_solution_path_number') AS on_, min(rank) FILTER (status = 'off_solution_path_number') AS off_,
        count(*) FILTER (rank <= {top_k}) AS picked, count(*) FILTER (rank <= {top_k} AND status = 'off_solution_path_number') AS picked_off,
        sum(rank) FILTER (status = 'on_solution_path_number') AS on_ranks, count(*) FILTER (status = 'on_solution_path_number') AS ons, sum(rank) FILTER (status = 'off_solution_path_number') AS off_ranks, count(*) FILTER (status = 'off_solution_path_number') AS offs,
        {', '.join(f"min(rank) FILTER (span_type = '{t}') AS t_{t}" for t in _TYPES)} FROM r GROUP BY ALL),
x AS (SELECT formula, {', '.join(f"{share(c, k)} AS top{k}_{n}_hit" for c, n in (('key', 'key'), ('b3', 'bucket3')) for k in (1, 2, 3))}, sum(picked_off) / sum(picked)::DOUBLE AS off_path_share,
        coalesce(sum(on_ranks) / nullif(sum(ons), 0)::DOUBLE, 0.0) AS on_path_rank_mean, coalesce(sum(off_ranks) / nullif(sum(offs), 0)::DOUBLE, 0.0) AS off_path_rank_mean, {share('on_', top_k)} AS on_path_coverage, {share('off_', top_k)} AS off_path_rate,
        {', '.join(f"{share('t_' + t, top_k)} AS {t}_coverage" for t in _TYPES)}, count(key) AS questions_with_key FROM g GROUP BY formula),
pp AS (SELECT a.formula, count(*) AS pairs, avg({_WIN})::DOUBLE AS pair_accuracy FROM f a JOIN f b ON a.formula = b.formula AND a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY a.formula),
bb AS (SELECT a.formula, avg({_WIN})::DOUBLE AS bucket_accuracy FROM f a JOIN f b ON a.formula = b.formula AND a.question_id = b.question_id AND a.bucket = 3 AND b.bucket = 1 GROUP BY a.formula),
metrics AS (SELECT x.*, coalesce(pairs, 0) AS pairs, coalesce(pair_accuracy, 0.0) AS pair_accuracy, bucket_accuracy FROM x LEFT JOIN pp USING (formula) LEFT JOIN bb USING (formula))
"""


_METRIC_COLUMNS = [f"top{k}_{n}_hit" for n in ("key", "bucket3") for k in (1, 2, 3)] + ["off_path_share", "on_path_rank_mean", "off_path_rank_mean", "on_path_coverage", "off_path_rate"] + [f"{t}_coverage" for t in _TYPES] + ["pair_accuracy", "bucket_accuracy"]


def formula_ranking(spark, d):
    return _rounded(M.ranking_metrics(M.budget(spans(spark, d))), digits=8)


FORMULA_RANKING = f"WITH {_BUDGET}, {_metrics()} SELECT formula, pairs, questions_with_key, {', '.join(f'round({c}, 8) AS {c}' for c in _METRIC_COLUMNS)} FROM metrics"


def keyness_report(spark, d):
    return _rounded(M.keyness_metrics(M.priority(spans(spark, d), digits=None)).select("formula", "positives", "negatives", "auc", "pair_accuracy", "top1", "top2", "mean_rank", "off_share"), digits=8)


KEYNESS_REPORT = f"""
WITH {_PRIORITY}, k AS (SELECT * FROM f WHERE status IN ('on_solution_path_number', 'off_solution_path_number')),
u AS (SELECT a.formula, avg({_WIN})::DOUBLE AS auc FROM k a JOIN k b ON a.formula = b.formula AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY a.formula),
pp AS (SELECT a.formula, avg({_WIN})::DOUBLE AS pair_accuracy FROM k a JOIN k b ON a.formula = b.formula AND a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY a.formula),
r AS (SELECT *, row_number() OVER (PARTITION BY formula, question_id ORDER BY score DESC, span_id) AS rank FROM k),
q AS (SELECT formula, question_id, min(rank) AS first, sum(rank) AS ranks, count(*) AS ons FROM r WHERE status = 'on_solution_path_number' GROUP BY ALL),
t AS (SELECT formula, avg(CAST(first <= 1 AS INTEGER))::DOUBLE AS top1, avg(CAST(first <= 2 AS INTEGER))::DOUBLE AS top2, sum(ranks) / sum(ons)::DOUBLE AS mean_rank FROM q GROUP BY formula),
n AS (SELECT formula, greatest(1, round_even(count(*) * 0.2, 0)::BIGINT) AS k, count(*) FILTER (status = 'on_solution_path_number') AS positives, count(*) FILTER (status = 'off_solution_path_number') AS negatives FROM k GROUP BY formula),
l AS (SELECT formula, score, count(*) AS c, count(*) FILTER (status = 'off_solution_path_number') AS o FROM k GROUP BY ALL),
w AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY formula ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM l),
s AS (SELECT w.formula, sum(o * (least(c, n.k - above) / c::DOUBLE)) / any_value(n.k) AS off_share FROM w JOIN n USING (formula) WHERE above < n.k GROUP BY w.formula)
SELECT formula, positives, negatives, round(auc, 8) AS auc, round(pair_accuracy, 8) AS pair_accuracy, round(top1, 8) AS top1, round(top2, 8) AS top2, round(mean_rank, 8) AS mean_rank, round(off_share, 8) AS off_share
FROM n LEFT JOIN u USING (formula) LEFT JOIN pp USING (formula) LEFT JOIN t USING (formula) LEFT JOIN s USING (formula)
"""


def best_formula(spark, d):
    m = M.ranking_metrics(M.priority(spans(spark, d), digits=None)).withColumn("precision", F.col("top1_bucket3_hit"))
    return M.chosen(m)


BEST_FORMULA = f"""
WITH {_PRIORITY}, {_metrics()}, c AS (SELECT bucket_accuracy AS c1, top1_bucket3_hit AS c2, off_path_share AS c3 FROM metrics WHERE formula = 'A_current_priority'),
v AS (SELECT formula, bucket_accuracy AS p, top1_bucket3_hit AS t, off_path_share AS o FROM metrics, c WHERE formula NOT IN ('A_current_priority', 'oracle_diagnostic_only')
  AND bucket_accuracy >= c1 AND top1_bucket3_hit >= c2 AND off_path_share <= c3 AND (bucket_accuracy > c1 OR top1_bucket3_hit > c2 OR off_path_share < c3))
SELECT coalesce((SELECT formula FROM v ORDER BY p DESC, t DESC, o LIMIT 1), 'A_current_priority') AS formula, (SELECT count(*) FROM v) AS viable
"""


def review_gate(spark, d):
    return M.gate(M.ranking_metrics(M.budget(spans(spark, d))))


REVIEW_GATE = f"""
WITH {_BUDGET}, {_metrics()}, s AS (SELECT pair_accuracy AS sa, off_path_share AS so, on_path_coverage AS sc FROM metrics WHERE formula = 'A_surface_only'),
b AS (SELECT * FROM metrics, s WHERE formula NOT IN ('A_surface_only', 'I_oracle_diagnostic_upper_bound') ORDER BY pair_accuracy DESC, formula DESC LIMIT 1),
c AS (SELECT formula AS best, (SELECT max(pairs) FROM metrics) > 0 AS computable, pair_accuracy - sa > 0.01 AS improves,
  (SELECT pair_accuracy FROM metrics WHERE formula = 'E_keyness_times_fragility') >= (SELECT pair_accuracy FROM metrics WHERE formula = 'D_hidden_plus_attention') AS product,
  off_path_share <= so AS budget, on_path_coverage >= sc AS covers, greatest(comparison_coverage, negation_coverage, condition_coverage) > 0 AS others FROM b)
SELECT *, CAST(computable AS INTEGER) + CAST(improves AS INTEGER) + CAST(product AS INTEGER) + CAST(budget AS INTEGER) + CAST(covers AS INTEGER) + CAST(others AS INTEGER) AS passed,
  computable AND improves AND product AND budget AND covers AND others AS ready FROM c
"""


def formula_bootstrap(spark, d):
    """Bootstrap over questions of each formula's mean gain in pair accuracy over the surface."""
    deltas = M.question_deltas(M.budget(spans(spark, d)), "A_surface_only")
    drawn = S.replicates(deltas, "question_id", 10, seed=2)
    out = drawn.groupBy("formula", "round").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("mean"))
    return _rounded(out, digits=8)


FORMULA_BOOTSTRAP = f"""
WITH {_BUDGET}, acc AS (SELECT a.formula, a.question_id, avg({_WIN})::DOUBLE AS acc FROM f a JOIN f b ON a.formula = b.formula AND a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY ALL),
d AS (SELECT a.formula, a.question_id, a.acc - s.acc AS delta FROM acc a JOIN acc s ON s.question_id = a.question_id AND s.formula = 'A_surface_only' AND a.formula <> 'A_surface_only'),
w AS (SELECT d.*, b.round, {_times('d.question_id', 2)} AS t FROM d, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS round) b)
SELECT formula, round, round(sum(delta * t) / sum(t), 8) AS mean FROM w WHERE t > 0 GROUP BY formula, round
"""


def prompt_response(spark, d):
    """Pair accuracy of the response's effect against the prompt's, the attention's and the surface's."""
    m = M.ranking_metrics(_responses(spark, d))
    of = lambda n: F.max(F.when(F.col("formula") == n, F.col("pair_accuracy")))
    out = m.agg(of("A_surface").alias("surface"), of("B_attention_only").alias("attention"), of("C_prompt_final_output_only").alias("prompt"), of("D_response_position_output_only").alias("response"))
    out = out.withColumns({"response_less_prompt": F.col("response") - F.col("prompt"), "response_less_surface": F.col("response") - F.col("surface"), "prompt_less_attention": F.col("prompt") - F.col("attention"), "better": F.col("response") > F.col("prompt")})
    return _rounded(out)


PROMPT_RESPONSE = f"""
WITH {_RESPONSES}, pp AS (SELECT a.formula, avg({_WIN})::DOUBLE AS acc FROM f a JOIN f b ON a.formula = b.formula AND a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY a.formula),
o AS (SELECT max(acc) FILTER (formula = 'A_surface') AS s, max(acc) FILTER (formula = 'B_attention_only') AS a, max(acc) FILTER (formula = 'C_prompt_final_output_only') AS p, max(acc) FILTER (formula = 'D_response_position_output_only') AS r FROM pp)
SELECT round(s, 9) AS surface, round(a, 9) AS attention, round(p, 9) AS prompt, round(r, 9) AS response, round(r - p, 9) AS response_less_prompt, round(r - s, 9) AS response_less_surface, round(p - a, 9) AS prompt_less_attention, r > p AS better FROM o
"""


def conflict_types(spark, d):
    return M.conflicts(spans(spark, d))


CONFLICT_TYPES = f"""
WITH s AS {SPANS}, p AS (SELECT sign(a.attention - b.attention) AS a, sign(a.hidden - b.hidden) AS h, sign(a.fused - b.fused) AS f, sign(a.output - b.output) AS o FROM s a JOIN s b ON a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number')
SELECT CASE WHEN a = 1 AND h = -1 AND f < 1 THEN 'A_attention_correct_hidden_hurts' WHEN a = 1 AND f = 1 THEN 'B_attention_correct_hidden_neutral' WHEN a = -1 AND h = 1 AND f = 1 THEN 'C_attention_wrong_hidden_fixes'
  WHEN a = -1 AND o = 1 THEN 'D_attention_wrong_output_fixes' WHEN a = -1 AND h = -1 AND o = -1 THEN 'E_all_wrong' END AS kind, count(*) AS pairs,
  CAST(sum(CASE WHEN a = 1 AND f = -1 THEN -1 WHEN a = -1 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS net_hidden, CAST(sum(CASE WHEN a = -1 AND o = 1 THEN 1 WHEN a = 1 AND o = -1 THEN -1 ELSE 0 END) AS BIGINT) AS net_output
FROM p GROUP BY 1
"""


def failure_reasons(spark, d):
    return M.reasons(spans(spark, d), "hidden").groupBy("reason").agg(F.count(F.lit(1)).alias("questions"))


FAILURE_REASONS = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hidden DESC, span_id) AS rank, coalesce(status = 'on_solution_path_number', false) AS on_, coalesce(status = 'off_solution_path_number', false) AS off_ FROM {SPANS}),
g AS (SELECT question_id, bool_or(rank = 1 AND off_) AS off_, bool_or(on_) AS on_, bool_or(span_type = 'comparison') AS c, bool_or(span_type = 'negation') AS n, bool_or(span_type = 'condition') AS k, bool_or(span_type = 'question_target') AS q,
  bool_or(rank = 1 AND span_type = 'object') AS o, count(*) FILTER (on_ OR span_type IN ({_KEYS})) AS e FROM r GROUP BY question_id)
SELECT CASE WHEN off_ THEN 'off_path_number_overranked' WHEN on_ THEN 'on_path_number_underranked' WHEN c THEN 'comparison_underranked' WHEN n THEN 'negation_underranked' WHEN k THEN 'condition_underranked' WHEN q THEN 'question_target_underranked'
  WHEN o THEN 'object_overranked' WHEN e = 0 THEN 'label_ambiguous' ELSE 'missing_reasoning_signal' END AS reason, count(*) AS questions FROM g GROUP BY 1
"""


def pair_success(spark, d):
    """Questions whose numbers on the path win at least half of the pairs, by formula."""
    rows = M.long(M.budget(spans(spark, d)))
    each = M._pairs(rows, F.col("status") == M.ON, F.col("status") == M.OFF, ["formula", "question_id"], ("pairs", "wins"))
    return each.groupBy("formula").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("wins") / F.col("pairs") >= 0.5).alias("won"))


PAIR_SUCCESS = f"WITH {_BUDGET}, q AS (SELECT a.formula, a.question_id, avg({_WIN}) AS w FROM f a JOIN f b ON a.formula = b.formula AND a.question_id = b.question_id AND a.status = 'on_solution_path_number' AND b.status = 'off_solution_path_number' GROUP BY ALL) SELECT formula, count(*) AS questions, count(*) FILTER (w >= 0.5) AS won FROM q GROUP BY formula"


def span_coverage(spark, d):
    return _rounded(M.coverage(spans(spark, d)))


SPAN_COVERAGE = f"""
WITH s AS {SPANS}, q AS (SELECT question_id, count(*) AS n, coalesce(bool_or(status = 'on_solution_path_number'), false) AS on_, coalesce(bool_or(status = 'off_solution_path_number'), false) AS off_, count(*) FILTER (span_type IN ('number', 'number_unit', 'rate')) AS nums, list(span_type) AS ts FROM s GROUP BY question_id)
SELECT count(*) AS questions, CAST(sum(n) AS BIGINT) AS spans, round(avg(n), 9) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS min, max(n) AS max, count(*) FILTER (n < 3) AS below_three, CAST(sum(nums) AS BIGINT) AS numbers, count(*) FILTER (nums > 0) AS with_numbers,
  count(*) FILTER (on_) AS with_on, count(*) FILTER (off_) AS with_off, count(*) FILTER (on_ AND off_) AS with_both, {', '.join(f"count(*) FILTER (list_contains(ts, '{t}')) AS with_{t}" for t in M.SURFACE_KEYNESS)} FROM q
"""


def type_breakdown(spark, d):
    s = spans(spark, d)
    out = s.groupBy("span_type").agg(F.count(F.lit(1)).alias("spans"), *[F.avg(c).alias(f"mean_{c}") for c in ("attention", "hidden", "output", "fused")], F.avg(F.coalesce(F.col("status") == M.OFF, F.lit(False)).cast("int")).alias("off_share"))
    return _rounded(out)


TYPE_BREAKDOWN = f"SELECT span_type, count(*) AS spans, {', '.join(f'round(avg({c}), 9) AS mean_{c}' for c in ('attention', 'hidden', 'output', 'fused'))}, round(avg(CAST(coalesce(status = 'off_solution_path_number', false) AS INTEGER)), 9) AS off_share FROM {SPANS} GROUP BY span_type"


def signal_separation(spark, d):
    """How each signal of numbers separates buckets that another table holds, joined by question and number: the last bucket of each counts."""
    s = spans(spark, d).where(F.col("span_type").isin(M.NUMBERS))
    known = s.groupBy("question_id", "n").agg(F.max_by("bucket", "span_id").alias("known"))
    rows = s.join(known, ["question_id", "n"]).select("known", F.inline(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("v")) for c in ("surface", "hidden", "attention", "output", "fused")])))
    auc = lambda low: S.auroc(rows.where(F.col("known").isin(low, 3)).withColumn("y", (F.col("known") == 3).cast("int")), "v", "y", ["signal"]).select("signal", F.col("auroc").alias(f"auc3{low}"))
    return _rounded(auc(1).join(auc(0), "signal").join(S.spearman(rows, "v", "known", ["signal"]), "signal"), digits=7)


SIGNAL_SEPARATION = f"""
WITH s AS (SELECT * FROM {SPANS} WHERE span_type IN ('number', 'number_unit', 'rate')), k AS (SELECT question_id, n, max_by(bucket, span_id) AS known FROM s GROUP BY ALL),
v AS (SELECT known, unnest([{', '.join(f"{{'signal': '{c}', 'v': {c}}}" for c in ('surface', 'hidden', 'attention', 'output', 'fused'))}], recursive := true) FROM s JOIN k USING (question_id, n)),
a AS (SELECT x.signal, avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0 END) AS auc31 FROM v x JOIN v y ON x.signal = y.signal AND x.known = 3 AND y.known = 1 GROUP BY x.signal),
b AS (SELECT x.signal, avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0 END) AS auc30 FROM v x JOIN v y ON x.signal = y.signal AND x.known = 3 AND y.known = 0 GROUP BY x.signal),
r AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2.0 AS p, rank() OVER (PARTITION BY signal ORDER BY known) + (count(*) OVER (PARTITION BY signal, known) - 1) / 2.0 AS q FROM v),
c AS (SELECT signal, count(*) AS rows, corr(p, q) AS spearman FROM r GROUP BY signal)
SELECT signal, round(auc31::DOUBLE, 7) AS auc31, round(auc30::DOUBLE, 7) AS auc30, rows, round(spearman, 7) AS spearman FROM a JOIN b USING (signal) JOIN c USING (signal)
"""


def score_matrix(spark, d):
    """Spans with scores of two prediction tables that lack some of them, scaled over all, ranked in their question."""
    base = spans(spark, d)
    one = base.where("bucket < 2").select("span_id", F.col("output").alias("score"))
    two = base.where("bucket = 2").select("span_id", F.col("hidden").alias("score"))
    out = M.matrix(base, [(one, "score", "priority"), (two, "score", "priority")], ["priority", "attention"], order="priority")
    return _rounded(out.groupBy("rank").agg(F.count(F.lit(1)).alias("spans"), F.count("priority").alias("scored"), F.avg("priority").alias("priority"), F.avg("attention").alias("attention")), digits=8)


SCORE_MATRIX = f"""
WITH s AS (SELECT *, CASE WHEN bucket < 2 THEN output WHEN bucket = 2 THEN hidden END AS priority FROM {SPANS}), g AS (SELECT min(priority) AS pl, max(priority) AS ph, min(attention) AS al, max(attention) AS ah FROM s),
x AS (SELECT question_id, span_id, (priority - pl) / (ph - pl) AS priority, (attention - al) / (ah - al) AS attention FROM s, g), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY priority DESC NULLS LAST, span_id) AS rank FROM x)
SELECT CAST(rank AS INTEGER) AS rank, count(*) AS spans, count(priority) AS scored, round(avg(priority), 8) AS priority, round(avg(attention), 8) AS attention FROM r GROUP BY rank
"""


def top_cases(spark, d):
    """The thirty best-scored spans that are no key (failures) and that are (successes)."""
    s = spans(spark, d).withColumn("key", (F.col("bucket") == 3) | F.coalesce(F.col("status") == M.ON, F.lit(False)))
    one = lambda test, name: s.where(test).orderBy(F.desc("hidden"), "span_id").limit(30).select(F.lit(name).alias("case"), "span_id", F.round("hidden", 9).alias("score"))
    return one("key", "success").unionByName(one("not key", "failure"))


TOP_CASES = f"""
WITH s AS (SELECT *, bucket = 3 OR coalesce(status = 'on_solution_path_number', false) AS key FROM {SPANS}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hidden DESC, span_id) AS r FROM s)
SELECT CASE WHEN key THEN 'success' ELSE 'failure' END AS "case", span_id, round(hidden, 9) AS score FROM r WHERE r <= 30
"""

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "priority_formulas", "budget_cap", "budget_formulas", "response_formulas", "formula_ranking", "keyness_report", "best_formula", "review_gate", "formula_bootstrap", "prompt_response", "conflict_types", "failure_reasons",
    "pair_success", "span_coverage", "type_breakdown", "signal_separation", "score_matrix", "top_cases",
)}
