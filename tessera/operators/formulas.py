"""Priority formulas over scored spans, their ranking metrics, and the choice among them.

A table of spans has question_id, span_id, span_type, status (of numbers: on, off or ambiguous of the solution's path),
bucket (0 to 3) and signals in [0, 1]. Formulas are columns of one pass; metrics work on (formula, question, span, score)
rows, in one shuffle for all formulas together. A question holds some dozen spans, so windows within one are small; what
is global (medians, scaling) comes from range partitions or one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .ordering import running_sums

# Names of statuses and number types.
ON, OFF, AMBIGUOUS = "on_solution_path_number", "off_solution_path_number", "ambiguous_number"
NUMBERS = ["number", "number_unit", "rate"]

# Keyness of span types, by rule set.
SURFACE_KEYNESS = {"number": 0.86, "number_unit": 0.88, "rate": 0.90, "comparison": 0.72, "negation": 0.70, "condition": 0.66, "operation": 0.64, "question_target": 0.44, "object": 0.24}
SEMANTIC_KEYNESS = {"number": 0.78, "number_unit": 0.82, "rate": 0.84, "operation": 0.72, "comparison": 0.76, "condition": 0.70, "negation": 0.70, "question_target": 0.65, "object": 0.28}

# Span types whose role is a key by itself.
KEY_TYPES = ["comparison", "negation", "condition", "operation", "question_target"]


def looked_up(column: str, table: dict[str, float], other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other))


def filled(name: str) -> Column:
    """The signal, or 0 where it is null or not finite."""
    from ..functions.vectors import finite

    return F.coalesce(finite(F.col(name)), F.lit(0.0))


def upper_median(df: DataFrame, value: Column) -> DataFrame:
    """One row (median): the value at place n // 2 of the ascending order; none without rows. Values are counted first, and the counts
    summed up by range partitions."""
    levels = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    summed = stored(running_sums(levels, [F.asc("v")], {"upto": F.col("n")}), "median")
    at = summed.agg((F.floor(F.max("upto") / 2) + 1).alias("at"))  # one row
    reached = summed.join(F.broadcast(at), F.col("upto") >= F.col("at"))
    return reached.groupBy("at").agg(F.min_by("v", "upto").alias("median")).select("median")


def priority(df: DataFrame, *, by: str = "question_id", key: str = "span_id", digits: int | None = 6) -> DataFrame:
    """df with formula_scores, a map from formula to score rounded to so many places, if any.

    Reads surface, hidden, attention, fused, current, bucket, span_type and status. A number below the global upper median of
    attention is held back in F; G lets one number of a question count in full, the second at 0.7, others at 0.45."""
    k, h, a, c = filled("surface"), filled("hidden"), filled("attention"), filled("current")
    med = upper_median(df, a)
    rows = df.join(F.broadcast(med), F.lit(True), "left").withColumn("b_", k * h)
    number = F.col("span_type") == "number"
    within = Window.partitionBy(by)
    rounded = lambda c: c if digits is None else F.round(c, digits)
    own = rounded(F.col("b_"))
    low, high = F.min(own).over(within), F.max(own).over(within)
    scaled = F.when(high == low, F.lit(0.5)).otherwise((own - low) / (high - low))
    place = F.row_number().over(Window.partitionBy(by, number).orderBy(own.desc(), key))
    solved = F.when(F.col("status") == ON, 1.0).when(F.col("status") == AMBIGUOUS, 0.5).otherwise(0.0)
    scores = {
        "A_current_priority": c, "B_keyness_times_fragility": F.col("b_"), "C_keyness_gate_then_fragility": F.when(k >= 0.55, h).otherwise(h * 0.25), "D_keyness_fragility_attention": F.col("b_") * (0.5 + a),
        "E_per_question_normalized_priority": scaled, "F_offpath_proxy_penalty": F.col("b_") * F.when(number & (a < F.col("median")), 0.75).otherwise(1.0),
        "G_span_type_budget_cap": own * F.when(~number, 1.0).when(place == 1, 1.0).when(place == 2, 0.70).otherwise(0.45),
        "surface_rule_baseline": k, "hidden_pre_recovery_baseline": h, "attention_pre_recovery_baseline": a, "hidden_plus_attention_baseline": filled("fused"), "oracle_diagnostic_only": solved * (F.coalesce(F.col("bucket"), F.lit(0)) / 3.0),
    }
    return rows.withColumn("formula_scores", F.create_map(*[x for n, v in scores.items() for x in (F.lit(n), rounded(v))])).drop("b_", "median")


def budget(df: DataFrame, *, by: str = "question_id") -> DataFrame:
    """df with formula_scores by keyness (mean of the surface and the semantic one) and fragility (mean of hidden and attention)."""
    key = (filled("surface") + looked_up("span_type", SEMANTIC_KEYNESS, 0.35)) / 2.0
    frag = (filled("hidden") + filled("attention")) / 2.0
    rows = df.withColumns({"k_": key, "f_": frag}).withColumn("e_", F.col("k_") * F.col("f_"))
    within = Window.partitionBy(by)
    low, high = F.min("e_").over(within), F.max("e_").over(within)
    scaled = F.when(high - low > 1e-12, (F.col("e_") - low) / (high - low)).otherwise(0.0)
    # Weights of span types in the budget policy
    policy = F.when(F.col("span_type") == "object", 0.55).when(F.col("span_type").isin("comparison", "negation", "condition"), 1.15).when(F.col("span_type").isin(NUMBERS), 0.96).otherwise(1.0)
    oracle = F.when(F.col("status") == ON, 1.0).when(F.col("status") == OFF, 0.0).when(F.col("span_type").isin(KEY_TYPES), 0.75).otherwise(0.2)
    scores = {
        "A_surface_only": filled("surface"), "B_hidden_only": filled("hidden"), "C_attention_only": filled("attention"), "D_hidden_plus_attention": F.col("f_"), "E_keyness_times_fragility": F.col("e_"),
        "F_keyness_gate_then_fragility": F.when(F.col("k_") >= 0.45, F.col("f_")).otherwise(0.05 * F.col("f_")), "G_per_question_normalized_priority": scaled, "H_span_type_budget_policy": F.col("e_") * policy,
        "I_oracle_diagnostic_upper_bound": oracle * F.col("f_"),
    }
    return rows.withColumn("formula_scores", F.create_map(*[x for n, v in scores.items() for x in (F.lit(n), v)])).drop("k_", "f_", "e_")


def responses(df: DataFrame, *, by: str = "question_id") -> DataFrame:
    """df with formula_scores of attention and output effect (prompt, response), gated by their upper medians in the question."""
    a, p, r = F.col("attention"), F.col("prompt"), F.col("response")
    within = Window.partitionBy(by)
    # the value at place n // 2 of those that are there: rows are numbered, for a list of the question beside each row would grow with its square
    placed = lambda c: F.row_number().over(within.orderBy(F.asc_nulls_last(c)))
    middle = lambda c, n, half: F.max(F.when(F.col(n) == F.col(half), F.col(c))).over(within)
    rows = df.withColumn("rn_", placed("response")).withColumn("an_", placed("attention"))
    counted = rows.withColumns({"rh_": F.floor(F.count("response").over(within) / 2) + 1, "ah_": F.floor(F.count("attention").over(within) / 2) + 1})
    rows = counted.withColumns({"rm_": middle("response", "rn_", "rh_"), "am_": middle("attention", "an_", "ah_")})
    scores = {
        "A_surface": F.col("surface"), "B_attention_only": a, "C_prompt_final_output_only": p, "D_response_position_output_only": r, "E_attention_x_prompt_final_output": a * p, "F_attention_x_response_position_output": a * r,
        "G_response_output_gate_then_attention": F.when(r >= F.col("rm_"), a).otherwise(0.02 * a), "H_attention_gate_then_response_output": F.when(a >= F.col("am_"), r).otherwise(0.02 * r),
        "I_mean_attention_response_output": 0.5 * (a + r), "J_max_attention_response_output": F.greatest(a, r), "K_min_attention_response_output": F.least(a, r),
    }
    return rows.withColumn("formula_scores", F.create_map(*[x for n, v in scores.items() for x in (F.lit(n), v)])).drop("rm_", "am_", "rn_", "an_", "rh_", "ah_")


def long(df: DataFrame) -> DataFrame:
    """(formula, score) rows beside the columns that ranking needs."""
    return df.select("question_id", "span_id", "span_type", "status", "bucket", F.explode("formula_scores").alias("formula", "score"))


def _pairs(rows: DataFrame, high: Column, low: Column, by: list[str], names: tuple[str, str]) -> DataFrame:
    """For each group: pairs of a high and a low row, and how many the high one wins (ties half), by ranks."""
    side = rows.select(*by, "score", high.alias("h_"), low.alias("l_")).where("h_ or l_")
    met = side.withColumns(_met({"w": (F.col("h_"), F.col("l_"))}, by))
    out = met.groupBy(*by).agg(F.count_if("h_").alias("p"), F.count_if("l_").alias("q"), F.sum("w_ahead").alias("w_ahead"), F.sum("w_behind").alias("w_behind"))
    pairs = F.col("p") * F.col("q")
    return out.where(pairs > 0).select(*by, pairs.alias(names[0]), _won("w", pairs).alias(names[1]))


def _met(sides: dict[str, tuple[Column, Column]], by: list[str]) -> dict[str, Column]:
    """For each name and its (high, low) rows: `_ahead`, at a low row the high rows of its group that score as much or more, and `_behind`, at
    a high row the low ones. All come from one descending order and one running frame."""
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(down)
    return {k: c for n, (high, low) in sides.items() for k, c in ((f"{n}_ahead", F.when(low, upto(high))), (f"{n}_behind", F.when(high, upto(low))))}


def _won(name: str, pairs: Column) -> Column:
    """Wins of high over low rows, ties half, from the sums of _met: ahead has wins and ties, behind has losses and ties."""
    return (F.coalesce(F.col(f"{name}_ahead"), F.lit(0)) - F.coalesce(F.col(f"{name}_behind"), F.lit(0)) + pairs) / 2.0


def ranking_metrics(df: DataFrame, top_k: int = 3) -> DataFrame:
    """One row a formula: pair accuracy of numbers on over off the path and of bucket 3 over 1 in the same question, hits at 1 to 3, shares
    and coverage of the first top_k. Ties in score go to the smaller span_id; shares without a base are 0.

    One scan: spans are dealt by question, before they are repeated for each formula, and ranks, pairs and hits of all formulas come from
    windows within questions that share one order. What is repeated are flags and places, not names. What follows are sums of a row for each
    question and formula."""
    by = ["formula", "question_id"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    on, off, b3, b1 = yes(F.col("status") == ON), yes(F.col("status") == OFF), yes(F.col("bucket") == 3), yes(F.col("bucket") == 1)
    types = ["comparison", "negation", "condition", "operation", "question_target"]
    flags = {"on_": on, "off_": off, "b3_": b3, "b1_": b1, "key_": on | yes(F.col("span_type").isin(KEY_TYPES)), **{f"is_{t}": yes(F.col("span_type") == t) for t in types}}
    # places by span_id are given once, and not compared again for each formula
    flat = df.withColumn("at_", F.row_number().over(Window.partitionBy("question_id").orderBy("span_id")))
    rows = flat.select("question_id", "at_", *[c.alias(n) for n, c in flags.items()], F.explode("formula_scores").alias("formula", "score")).withColumn("score", filled("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "at_"))).withColumns(_met({"on": (F.col("on_"), F.col("off_")), "b3": (F.col("b3_"), F.col("b1_"))}, by))
    top = F.col("rank") <= top_k
    first = lambda c: F.min(F.when(F.col(c), F.col("rank")))
    each = ranked.groupBy(*by).agg(
        first("key_").alias("key"), first("b3_").alias("b3"), first("on_").alias("on"), first("off_").alias("off"), F.count_if(top).alias("picked"), F.count_if(top & F.col("off_")).alias("picked_off"), F.sum(F.when(F.col("on_"), F.col("rank"))).alias("on_ranks"),
        F.count_if("on_").alias("ons"), F.sum(F.when(F.col("off_"), F.col("rank"))).alias("off_ranks"), F.count_if("off_").alias("offs"), *[first(f"is_{t}").alias(t) for t in types], *[F.sum(c).alias(c) for c in ("on_ahead", "on_behind", "b3_ahead", "b3_behind")],
        F.count_if("b3_").alias("b3s"), F.count_if("b1_").alias("b1s"),
    )
    share = lambda hit, base: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(base)), F.lit(0.0))
    hits = [share(F.col(c) <= k, F.col(c).isNotNull()).alias(f"top{k}_{n}_hit") for c, n in (("key", "key"), ("b3", "bucket3")) for k in (1, 2, 3)]
    pairs, buckets = F.col("ons") * F.col("offs"), F.col("b3s") * F.col("b1s")
    won = lambda wins, met: F.try_divide(F.sum(F.when(met > 0, _won(wins, met))), F.sum(met))
    return each.groupBy("formula").agg(
        *hits, F.try_divide(F.sum("picked_off"), F.sum("picked")).alias("off_path_share"), F.coalesce(F.try_divide(F.sum("on_ranks"), F.sum("ons")), F.lit(0.0)).alias("on_path_rank_mean"), F.coalesce(F.try_divide(F.sum("off_ranks"), F.sum("offs")), F.lit(0.0)).alias("off_path_rank_mean"),
        share(F.col("on") <= top_k, F.col("on").isNotNull()).alias("on_path_coverage"), share(F.col("off") <= top_k, F.col("off").isNotNull()).alias("off_path_rate"), *[share(F.col(t) <= top_k, F.col(t).isNotNull()).alias(f"{t}_coverage") for t in types],
        F.count("key").alias("questions_with_key"), F.sum(pairs).alias("pairs"), F.coalesce(won("on", pairs), F.lit(0.0)).alias("pair_accuracy"), won("b3", buckets).alias("bucket_accuracy"),
    )


def question_deltas(df: DataFrame, baseline: str) -> DataFrame:
    """(formula, question_id, delta): pair accuracy of numbers on over off the path less the baseline's, for questions that have such pairs."""
    each = _pairs(long(df).withColumn("score", filled("score")), F.col("status") == ON, F.col("status") == OFF, ["formula", "question_id"], ("pairs", "wins")).withColumn("acc", F.col("wins") / F.col("pairs"))
    base = each.where(F.col("formula") == baseline).select("question_id", F.col("acc").alias("base"))
    return each.where(F.col("formula") != baseline).join(base, "question_id").select("formula", "question_id", (F.col("acc") - F.col("base")).alias("delta"))


def keyness_metrics(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """One row a formula over numbers on or off the path: AUROC, pair accuracy in the same question, share of questions whose first (first two)
    is on the path, off-path share of the best `fraction`, mean rank of numbers on the path.

    Two passes over the spans: one by question, as in ranking_metrics, and one that counts rows by formula and score. The counts are put in one
    order of formulas and scores by range partitions, from which AUROC and the best fraction follow; no task ranks a formula."""
    by = ["formula", "question_id"]
    numbers = df.where(F.col("status").isin(ON, OFF)).withColumn("at_", F.row_number().over(Window.partitionBy("question_id").orderBy("span_id")))
    rows = numbers.select("question_id", "at_", (F.col("status") == ON).alias("on_"), F.explode("formula_scores").alias("formula", "score")).where(F.col("score").isNotNull())
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "at_"))).withColumns(_met({"on": (F.col("on_"), ~F.col("on_"))}, by))
    each = ranked.groupBy(*by).agg(F.min(F.when(F.col("on_"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("on_"), F.col("rank"))).alias("ranks"), F.count_if("on_").alias("ons"), F.count_if(~F.col("on_")).alias("offs"), F.sum("on_ahead").alias("on_ahead"), F.sum("on_behind").alias("on_behind"))
    some, met = F.col("ons") > 0, F.col("ons") * F.col("offs")
    tops = each.groupBy("formula").agg(
        F.try_divide(F.sum(F.when(met > 0, _won("on", met))), F.sum(met)).alias("pair_accuracy"), F.avg(F.when(some, (F.col("first") <= 1).cast("int"))).alias("top1"), F.avg(F.when(some, (F.col("first") <= 2).cast("int"))).alias("top2"), F.try_divide(F.sum("ranks"), F.sum("ons")).alias("mean_rank"),
    )
    levels = rows.groupBy("formula", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("on_")).alias("off"))
    summed = stored(running_sums(levels, [F.asc("formula"), F.desc("score")], {"upto": F.col("n")}), "levels")
    totals = summed.groupBy("formula").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("all"), F.sum(F.col("n") - F.col("off")).alias("positives"), F.sum("off").alias("negatives"))
    # one row a formula
    placed = summed.join(F.broadcast(totals), "formula").withColumn("above", F.col("upto") - F.col("n") - F.col("start"))
    k = F.greatest(F.lit(1), F.bround(F.col("all") * fraction).cast("long"))
    # a level that the cut passes through counts in proportion
    inside = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("above"))) / F.col("n")
    rank = F.col("all") - F.col("above") - (F.col("n") - 1) / 2.0  # from low to high, ties at their mean
    p, q = F.first("positives"), F.first("negatives")
    whole = placed.groupBy("formula").agg(p.alias("positives"), q.alias("negatives"), F.sum((F.col("n") - F.col("off")) * rank).alias("sr"), (F.sum(F.col("off") * inside) / F.first(k)).alias("off_share"))
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), (F.col("sr") - F.col("positives") * (F.col("positives") + 1) / 2.0) / (F.col("positives") * F.col("negatives")))
    return whole.withColumn("auc", auc).drop("sr").join(F.broadcast(tops), "formula", "left")


def chosen(metrics: DataFrame, current: str = "A_current_priority", barred: tuple[str, ...] = ("oracle_diagnostic_only",)) -> DataFrame:
    """One row: the formula that is no worse than the current one by bucket accuracy, hits and off-path share, better in one of them, and the
    best by these in turn; the current one where there is none. metrics has bucket_accuracy, precision and off_path_share."""
    metrics = stored(metrics, "metrics")  # a row a formula, read twice
    own = metrics.where(F.col("formula") == current).select(F.col("bucket_accuracy").alias("c1"), F.col("precision").alias("c2"), F.col("off_path_share").alias("c3"))
    rows = metrics.where((F.col("formula") != current) & ~F.col("formula").isin(*barred)).join(F.broadcast(own))
    p, t, o = F.col("bucket_accuracy"), F.col("precision"), F.col("off_path_share")
    fine = F.coalesce(p >= F.col("c1"), F.lit(True)) & F.coalesce(t >= F.col("c2"), F.lit(False)) & F.coalesce(o <= F.col("c3"), F.lit(False))
    better = F.coalesce(p > F.col("c1"), F.lit(False)) | F.coalesce(t > F.col("c2"), F.lit(False)) | F.coalesce(o < F.col("c3"), F.lit(False))
    best = F.max_by("formula", F.struct(F.coalesce(p, F.lit(-1.0)), F.coalesce(t, F.lit(-1.0)), -F.coalesce(o, F.lit(1.0))))
    return rows.where(fine & better).agg(F.coalesce(best, F.lit(current)).alias("formula"), F.count(F.lit(1)).alias("viable"))


def conflicts(df: DataFrame, signals: tuple[str, str, str, str] = ("attention", "hidden", "fused", "output")) -> DataFrame:
    """(kind, pairs): pairs of a number on and one off the path of a question by how four signals order them; null is no kind.
    Pairs are made within a question, which holds some dozen spans, and counted where they are made."""
    cells = df.where(F.col("status").isin(ON, OFF)).groupBy("question_id").agg(*[F.collect_list(F.when(F.col("status") == s, F.struct(*[F.col(x).alias(f"s{i}") for i, x in enumerate(signals)]))).alias(n) for s, n in ((ON, "on"), (OFF, "off"))])
    word = lambda a, b: F.when(a > b, "correct").when(a < b, "wrong").otherwise("tie")
    met = cells.where((F.size("on") > 0) & (F.size("off") > 0)).select(F.explode("on").alias("x"), "off").select("x", F.explode("off").alias("y"))
    a, h, f, o = (word(F.col(f"x.s{i}"), F.col(f"y.s{i}")) for i in range(4))
    kind = (
        F.when((a == "correct") & (h == "wrong") & f.isin("wrong", "tie"), "A_attention_correct_hidden_hurts").when((a == "correct") & (f == "correct"), "B_attention_correct_hidden_neutral")
        .when((a == "wrong") & (h == "correct") & (f == "correct"), "C_attention_wrong_hidden_fixes").when((a == "wrong") & (o == "correct"), "D_attention_wrong_output_fixes").when((a == "wrong") & (h == "wrong") & (o == "wrong"), "E_all_wrong")
    )
    help_ = F.when((a == "correct") & (f == "wrong"), -1).when((a == "wrong") & (f == "correct"), 1).otherwise(0)
    out_help = F.when((a == "wrong") & (o == "correct"), 1).when((a == "correct") & (o == "wrong"), -1).otherwise(0)
    return met.select(kind.alias("kind"), help_.alias("h"), out_help.alias("o")).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.sum("h").alias("net_hidden"), F.sum("o").alias("net_output"))


def reasons(df: DataFrame, score: str, top_k: int = 1) -> DataFrame:
    """(question_id, reason): why the first spans of a question may be wrong, by ordered rules over them and its expected ones."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(score), "span_id")))
    top, expected = F.col("rank") <= top_k, (F.col("status") == ON) | F.col("span_type").isin(KEY_TYPES)
    each = ranked.groupBy("question_id").agg(
        F.bool_or(top & F.coalesce(F.col("status") == OFF, F.lit(False))).alias("off"), F.bool_or(F.coalesce(expected & (F.col("status") == ON), F.lit(False))).alias("on"), F.collect_set(F.when(expected, F.col("span_type"))).alias("types"),
        F.bool_or(top & (F.col("span_type") == "object")).alias("object"), F.count_if(F.coalesce(expected, F.lit(False))).alias("expected"),
    )
    reason = F.when(F.col("off"), "off_path_number_overranked").when(F.col("on"), "on_path_number_underranked")
    for kind in ("comparison", "negation", "condition", "question_target"):
        reason = reason.when(F.array_contains("types", kind), f"{kind}_underranked")
    return each.select("question_id", reason.when(F.col("object"), "object_overranked").when(F.col("expected") == 0, "label_ambiguous").otherwise("missing_reasoning_signal").alias("reason"))


def coverage(df: DataFrame) -> DataFrame:
    """One row: questions and spans, spans a question, questions with each status and with both, questions with each type."""
    each = df.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("status") == ON, F.lit(False))).alias("on"), F.bool_or(F.coalesce(F.col("status") == OFF, F.lit(False))).alias("off"), F.count_if(F.col("span_type").isin(NUMBERS)).alias("numbers"), *[F.bool_or(F.col("span_type") == t).alias(t) for t in SURFACE_KEYNESS])
    return each.agg(
        F.count(F.lit(1)).alias("questions"), F.sum("n").alias("spans"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.count_if(F.col("n") < 3).alias("below_three"),
        F.sum("numbers").alias("numbers"), F.count_if(F.col("numbers") > 0).alias("with_numbers"), F.count_if("on").alias("with_on"), F.count_if("off").alias("with_off"), F.count_if(F.col("on") & F.col("off")).alias("with_both"), *[F.count_if(t).alias(f"with_{t}") for t in SURFACE_KEYNESS],
    )


def gate(metrics: DataFrame, surface: str = "A_surface_only", single: str = "D_hidden_plus_attention", product: str = "E_keyness_times_fragility", barred: tuple[str, ...] = ("I_oracle_diagnostic_upper_bound",)) -> DataFrame:
    """One row of named checks over ranking metrics, how many pass, and whether all do. The best formula is that with the largest gain in
    pair accuracy over the surface."""
    metrics = stored(metrics, "metrics")  # a row a formula, read twice
    base = F.broadcast(metrics.where(F.col("formula") == surface).select(F.col("pair_accuracy").alias("sa"), F.col("off_path_share").alias("so"), F.col("on_path_coverage").alias("sc")))
    rows = metrics.join(base)
    free = ~F.col("formula").isin(surface, *barred)
    best = F.max_by(F.struct("formula", "pair_accuracy", "off_path_share", "on_path_coverage", "comparison_coverage", "negation_coverage", "condition_coverage", "sa", "so", "sc"), F.when(free, F.struct("pair_accuracy", "formula")))
    of = lambda name: F.max(F.when(F.col("formula") == name, F.col("pair_accuracy")))
    out = rows.agg(best.alias("b"), F.max("pairs").alias("pairs"), of(single).alias("single"), of(product).alias("product"))
    checks = {
        "computable": F.col("pairs") > 0, "improves": F.col("b.pair_accuracy") - F.col("b.sa") > 0.01, "product": F.col("product") >= F.col("single"), "budget": F.col("b.off_path_share") <= F.col("b.so"), "covers": F.col("b.on_path_coverage") >= F.col("b.sc"),
        "others": F.greatest("b.comparison_coverage", "b.negation_coverage", "b.condition_coverage") > 0,
    }
    out = out.select(F.col("b.formula").alias("best"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    return out.select("*", passed.alias("passed"), (passed == len(checks)).alias("ready"))


def matrix(base: DataFrame, predictions: list[tuple[DataFrame, str, str]], scaled: list[str], *, key: str = "span_id", by: str = "question_id", order: str) -> DataFrame:
    """base with columns of prediction tables joined by key and the first that is filled taken, in the order given as (table, column, name);
    then `scaled` columns at 0 to 1 over the whole table, and rank of `order` within each question (ties by key)."""
    from .ranking import scaled as minmax

    out = base
    for i, (table, column, _) in enumerate(predictions):
        out = out.join(table.select(key, F.col(column).alias(f"p{i}_")), key, "left")
    for name in dict.fromkeys(n for *_, n in predictions):
        own = [F.col(name)] if name in base.columns else []
        out = out.withColumn(name, F.coalesce(*[F.col(f"p{i}_") for i, (*_, n) in enumerate(predictions) if n == name], *own))
    out = minmax(out.drop(*[f"p{i}_" for i in range(len(predictions))]), scaled)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(order), key)))
