"""From questions to anchors: the stages of a perturbation study, each a DataFrame of records.

Where a study would ask a model (entailment, recovery), a rule stands in; a model's scores come in as columns of the
same names. Every stage keeps the keys (id, unit_id), so stages can be stored and joined in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import joins as J
from ..operators import spans as S


def questions(raw: DataFrame) -> DataFrame:
    """id, dataset, question, gold_answer: trimmed; ids must be filled and unique."""
    from ..operators import contracts as K

    K.require(raw, ["id", "dataset", "question", "gold_answer"])
    rows = raw.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in ("id", "dataset", "question", "gold_answer")])
    return K.require_unique(K.enforce(rows, {"id filled": K.filled(F.col("id")), "question filled": K.filled(F.col("question"))}, "id"), ["id"])


def units(rows: DataFrame, **limits) -> DataFrame:
    """One row per unit: id, question, unit_id (unit_001 and on), unit_scope, group_type, span_ids, spans, reason."""
    found = S.with_units(rows.select("id", "question"), "question", **limits)
    return found.select("id", "question", F.posexplode("units").alias("i", "u")).select("id", "question", F.format_string("unit_%03d", F.col("i") + 1).alias("unit_id"), "u.*")


def ablated(unit_rows: DataFrame, kinds: tuple[str, ...] = ("delete", "generalize"), setting: str = "auto") -> DataFrame:
    """unit rows times kinds of ablation, with ablation_id, ablated_question and status; only status `kept` goes on."""
    rows = S.ablations(unit_rows.withColumn("unit", F.struct("spans")), "question", "unit", kinds, setting).drop("unit")
    return rows.withColumnRenamed("ablated", "ablated_question").withColumn("ablation_id", F.concat_ws("__", "id", "unit_id", "kind"))


def entailed(rows: DataFrame) -> DataFrame:
    """Kept ablations with nli_id, language, forward and backward scores, both (the smaller entailment) and contradiction."""
    n = F.size("span_ids")
    out = rows.where("status = 'kept'").withColumns({"forward": R.entailment(F.col("kind"), n, "forward"), "backward": R.entailment(F.col("kind"), n, "backward"), "language": X.language(F.concat_ws("\n", "question", "ablated_question")), "nli_id": F.concat_ws("__", "ablation_id", F.lit("nli"))})
    return out.withColumns({"both": F.least("forward.entailment", "backward.entailment"), "contradiction": F.greatest("forward.contradiction", "backward.contradiction")})


def labelled(rows: DataFrame, **thresholds) -> DataFrame:
    """Entailed rows with the necessity struct (label, reason, score) and whether the unit is necessary."""
    n = R.necessity(F.col("forward.entailment"), F.col("backward.entailment"), F.col("contradiction"), **thresholds)
    return rows.withColumn("necessity", n).withColumn("necessary", F.col("necessity.label") != "Equivalent")


def masked(rows: DataFrame, *, token: str = "[MASK]", only_necessary: bool = True) -> DataFrame:
    """One row per unit with a necessary ablation (or per unit): masked_id, masked_question and the ablations it comes from."""
    order = F.when(F.col("kind") == "delete", 0).otherwise(1)
    source = F.struct(order.alias("o"), "kind", "ablation_id", F.col("necessity.label").alias("label"), F.col("necessity.score").alias("score"), "necessary")
    out = rows.groupBy("id", "unit_id").agg(F.first("question").alias("question"), F.first("group_type").alias("group_type"), F.first("spans").alias("spans"), F.bool_or("necessary").alias("any_necessary"), F.array_sort(F.collect_list(source)).alias("sources"))
    out = out.where(~X.overlapping(F.col("spans")))
    if only_necessary:
        out = out.where("any_necessary")
    return out.withColumns({"masked_id": F.concat_ws("__", "id", "unit_id", F.lit("mask")), "masked_question": X.masked(F.col("question"), F.col("spans"), token)})


def recovered(rows: DataFrame, samples: int = 3, *, answer: Column | None = None) -> DataFrame:
    """`samples` rows per masked question: sample_id and recovered_question (the original unless given)."""
    given = answer if answer is not None else F.col("question")
    return rows.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("recovered_question", given)


def recovery_scores(rows: DataFrame) -> DataFrame:
    """One row per masked question: samples, exact, empty and wrong recoveries, label, score, consistency, misleading."""
    a, b = X.collapsed(F.col("question")), X.collapsed(F.coalesce("recovered_question", F.lit("")))
    values = rows.groupBy("masked_id", "id", "unit_id", b.alias("r"), (b == a).alias("same")).agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy("masked_id", "id", "unit_id").agg(F.sum("n").alias("samples"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("exact"), F.sum(F.when(F.col("r") == "", F.col("n")).otherwise(0)).alias("empty"), F.max("n").alias("most"))
    wrong = F.col("samples") - F.col("exact") - F.col("empty")
    return out.select(
        "masked_id", "id", "unit_id", "samples", "exact", "empty", wrong.alias("wrong"), R.exact_recovery(F.col("samples"), F.col("exact"), wrong).alias("recoverability"),
        (F.col("exact") / F.col("samples")).alias("recoverability_score"), (F.col("most") / F.col("samples")).alias("consistency"), (wrong > 0).alias("misleading"),
    )


def evidence(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per unit that has both kinds of evidence on record: the vote over its ablations beside its recovery. Keys that
    only one side has are an error."""
    summary = labels.groupBy("id", "unit_id").agg(F.count(F.lit(1)).alias("records"), F.count_if("necessary").alias("necessary"), F.max("necessity.score").alias("semantic_score"), F.array_sort(F.collect_set("necessity.label")).alias("labels"))
    summary = summary.withColumn("vote", R.votes(F.col("necessary"), F.col("records")))
    return J.strict_join(summary, scores.drop("masked_id"), ["id", "unit_id"], one_to_one=True)


def anchors(rows: DataFrame) -> DataFrame:
    a = R.anchor(F.col("semantic_score"), F.col("recoverability"), F.col("misleading"))
    return rows.withColumn("anchor", a).select("*", F.col("anchor.score").alias("importance"), F.col("anchor.label").alias("anchor_label")).drop("anchor")


def interventions(rows: DataFrame, unit_rows: DataFrame, kind: str = "mask", token: str = "[MASK]") -> DataFrame:
    """A planned operation for every anchor; nothing is carried out."""
    spans = unit_rows.select("id", "unit_id", "span_ids", F.transform("spans", lambda s: s["text"]).alias("target_texts"))
    out = rows.select("id", "unit_id", "importance", "anchor_label").join(spans, ["id", "unit_id"])
    return out.select(F.concat_ws("__", "id", "unit_id", F.lit(kind)).alias("intervention_id"), "*", F.lit(f"{kind}_unit").alias("operation"), F.when(F.lit(kind == "mask"), F.lit(token)).alias("mask_token"), F.lit("planned_only").alias("status"))


def study(raw: DataFrame, samples: int = 3) -> dict[str, DataFrame]:
    """All stages by name."""
    q = questions(raw)
    u = units(q)
    a = ablated(u)
    n = labelled(entailed(a))
    m = masked(n)
    r = recovered(m, samples)
    s = recovery_scores(r)
    e = evidence(J.kept(n, s, ["id", "unit_id"]), s)
    x = anchors(e)
    return {"questions": q, "units": u, "ablated": a, "labelled": n, "masked": m, "recovered": r, "scores": s, "evidence": e, "anchors": x, "interventions": interventions(x, u)}
