"""From evidence to probes: targets by rules, feature groups, planned guidance, weak labels, answers to multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import finite
from .contracts import ContractError

# Columns that a human review must have filled before a target is mapped.
REQUIRED = ["human_attention_anchor_label", "human_recoverability_label", "human_semantic_role", "human_guidance_priority", "human_error_type"]

# Roles of critical numbers.
NUMBER_ROLES = ["critical_number", "key_number", "important_number", "number"]

# What a predicted target proposes.
ACTIONS = {
    "risk_positive": (True, "increase_attention_to_original_span", "probe predicted high-risk recovery drift; original span should be emphasized in future attention guidance"),
    "positive_anchor": (True, "preserve_original_span_attention", "probe predicted useful anchor; original span should be preserved as candidate attention anchor"),
    "hard_negative_or_weak_positive": (True, "review_before_guidance", "probe predicted ambiguous weak signal; requires review before real guidance"),
    "negative": (False, "no_guidance", "probe predicted negative; no guidance candidate proposed"),
}

# Target, rule and confidence by type of span.
WEAK_TARGETS = {
    "number": ("positive_anchor", "span_type_number_critical_value", 0.8),
    "question_target": ("positive_anchor", "span_type_question_target_anchor", 0.7),
    "negation": ("risk_positive", "span_type_negation_meaning_flip_risk", 0.8),
    "comparison": ("risk_positive", "span_type_comparison_direction_risk", 0.65),
    "cyber_security_term": ("risk_positive", "span_type_security_term_risk", 0.7),
    "operation": ("hard_negative_or_weak_positive", "span_type_operation_ambiguous", 0.5),
    "condition": ("hard_negative_or_weak_positive", "span_type_condition_ambiguous", 0.5),
    "object": ("negative", "span_type_object_recoverable", 0.6),
    "entity": ("negative", "span_type_entity_recoverable", 0.6),
    "relation": ("negative", "span_type_relation_low_value", 0.55),
}

# What stands in for a span of a type.
FILLERS = {"number": "several", "question_target": "what number", "negation": "indeed", "comparison": "compared", "cyber_security_term": "an issue", "operation": "changes", "condition": "when", "object": "items", "entity": "someone", "relation": "and"}


def metadata_conflicts(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides whose columns differ (nulls are equal), with the names that do."""
    a, b = left.select(*on, F.struct(*columns).alias("a")), right.select(*on, F.struct(*columns).alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in columns]))
    return a.join(b, on).select(*on, differ.alias("differ")).where(F.size("differ") > 0)


def agreed(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """left, if the other side has the same columns for every common key; else an error names one."""
    first = metadata_conflicts(left, right, on, columns).limit(1).collect()
    if first:
        raise ContractError(f"key {tuple(first[0][k] for k in on)}: {', '.join(first[0]['differ'])} differ")
    return left


def probe_target() -> Column:
    """struct(target, usable, status, rule) of a reviewed record by ordered rules; a usage of `exclude` or `uncertain` makes it unusable."""
    form = lambda c: F.coalesce(X.key_form(F.col(c)), F.lit(""))
    fields = {"error": "human_error_type", "role": "human_semantic_role", "priority": "human_guidance_priority", "recover": "human_recoverability_label", "anchor": "human_attention_anchor_label", "usage": "probe_usage"}
    missing = X.any_of(*[F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in REQUIRED])
    # the forms are worked out once a row, in an array of one, and not anew in every rule that reads them
    bound = F.array(F.struct(missing.alias("missing"), *[form(c).alias(n) for n, c in fields.items()]))
    return F.element_at(F.transform(bound, _mapped), 1)


def _mapped(b: Column) -> Column:
    error, role, priority, recover, anchor, usage = (b[n] for n in ("error", "role", "priority", "recover", "anchor", "usage"))
    rules = [
        (b["missing"], "unmapped", "missing_human_metadata"), (error.isin("wrong_numeric_recovery", "misleading_entity_or_unit"), "risk_positive", "human_error_type_risk_positive"),
        ((error == "generic_recovery") & role.isin(NUMBER_ROLES), "positive_anchor", "generic_recovery_critical_number"), (error == "generic_recovery", "hard_negative_or_weak_positive", "generic_recovery_noncritical"),
        (error == "semantic_equivalent_recovery", "negative", "semantic_equivalent_recovery"), ((error == "fragment_recovery") & priority.isin("low", "none"), "negative", "fragment_recovery_low_priority"),
        (error.isin("semantically_meaningful_but_recoverable", "recoverable_but_semantically_meaningful_span"), "hard_negative_or_weak_positive", "meaningful_but_recoverable"),
        (recover.isin("recoverable", "partially_recoverable") & anchor.isin("weak_anchor", "medium_anchor") & priority.isin("low", "medium"), "hard_negative_or_weak_positive", "recoverable_weak_or_medium_anchor"),
    ]
    out = F.struct(F.lit("unmapped").alias("target"), F.lit("no_matching_mapping_rule").alias("rule"))
    for test, target, rule in reversed(rules):
        out = F.when(test, F.struct(F.lit(target).alias("target"), F.lit(rule).alias("rule"))).otherwise(out)
    mapped = out["target"] != "unmapped"
    status = F.when(~mapped, F.when(out["rule"] == "missing_human_metadata", "missing_human_metadata").otherwise("unmapped")).when(usage == "exclude", "excluded_by_probe_usage").when(usage == "uncertain", "uncertain_probe_usage").otherwise("mapped")
    return F.struct(out["target"].alias("target"), (status == "mapped").alias("usable"), status.alias("status"), out["rule"].alias("rule"))


def usable(df: DataFrame, target: str = "target") -> DataFrame:
    """Records that may train: usable and mapped."""
    return df.where(F.coalesce(F.col("usable"), F.lit(False)) & (F.col(target) != "unmapped"))


def null_features(features: Column) -> Column:
    """Sorted names of the features of a map that are null."""
    return F.array_sort(F.map_keys(F.map_filter(features, lambda k, v: v.isNull())))


def by_layer(arrays: Column) -> Column:
    """The entries of a map of arrays whose names end in `_by_layer`: features that are kept as arrays."""
    return F.map_filter(arrays, lambda k, v: k.endswith("_by_layer"))


def guidance(scores: Column, predicted: Column) -> Column:
    """struct(predicted, second, margin, confidence, guide, action, reason, status): how far a prediction leads the best other score, and what it proposes."""
    clean = F.map_filter(F.transform_values(scores, lambda k, v: finite(v)), lambda k, v: v.isNotNull())
    own = F.try_element_at(clean, predicted)
    second = F.when(own.isNotNull(), F.array_max(F.map_values(F.map_filter(clean, lambda k, v: k != predicted))))
    margin = own - second
    level = F.when(margin.isNull(), "unknown").when(margin >= 0.5, "high").when(margin >= 0.1, "medium").otherwise("low")
    action = F.struct(F.lit(False).alias("guide"), F.lit("no_guidance").alias("action"), F.concat(F.lit("unsupported predicted_probe_target '"), predicted, F.lit("'; no guidance candidate proposed")).alias("reason"))
    for name, (guide, what, why) in ACTIONS.items():
        action = F.when(predicted == name, F.struct(F.lit(guide).alias("guide"), F.lit(what).alias("action"), F.lit(why).alias("reason"))).otherwise(action)
    return F.struct(own.alias("predicted"), second.alias("second"), margin.alias("margin"), level.alias("confidence"), action["guide"].alias("guide"), action["action"].alias("action"), action["reason"].alias("reason"), F.lit("planned_only").alias("status"))


def feature_group(name: Column) -> Column:
    """The part of an input that a feature describes."""
    return F.when(name.endswith("__is_missing"), "missing_indicator").when(name.startswith("question_"), "question").when(name.startswith("span_"), "span").when(name.startswith("mask_position_"), "mask_position").otherwise("other")


def layer_group(name: Column) -> Column:
    """The layer that a feature describes, or what kind of summary it is."""
    layer = F.split(F.split(name, "_layer_", 2)[1], "__", 2)[0]
    return F.when(name.endswith("__is_missing"), "missing_indicator").when(F.contains(name, F.lit("_layer_")), F.concat(F.lit("layer_"), layer)).otherwise("summary_scalar")


def weight_summary(weights: DataFrame) -> DataFrame:
    """(grouping, name, features, mean_weight): mean over classes of the absolute weight, by feature group and by layer.
    weights has class, feature and weight."""
    mean = weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("w"))
    sides = F.array(F.struct(F.lit("group").alias("grouping"), feature_group(F.col("feature")).alias("name")), F.struct(F.lit("layer").alias("grouping"), layer_group(F.col("feature")).alias("name")))
    return mean.select("w", F.inline(sides)).groupBy("grouping", "name").agg(F.count(F.lit(1)).alias("features"), F.avg("w").alias("mean_weight"))


def top_weights(weights: DataFrame, k: int = 10) -> DataFrame:
    """The k features of the largest mean absolute weight, with their weights by class; ties by name."""
    return weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("mean_weight"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "weight")))).alias("by_class")).orderBy(F.desc("mean_weight"), "feature").limit(k)


def weak_target(span_type: Column) -> Column:
    """struct(target, rule, confidence, usable) by type of span alone."""
    out = F.struct(F.lit("unmapped").alias("target"), F.lit("no_matching_span_type_rule").alias("rule"), F.lit(0.0).alias("confidence"), F.lit(False).alias("usable"))
    for name, (target, rule, confidence) in WEAK_TARGETS.items():
        out = F.when(span_type == name, F.struct(F.lit(target).alias("target"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), F.lit(True).alias("usable"))).otherwise(out)
    return out


def filler_for(span_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in FILLERS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, span_type), F.lit("something"))


def input_specs(df: DataFrame, key: str) -> DataFrame:
    """(key, input_type, input_index, input_text): original, masked and each recovered question of a case."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("input_type"), F.lit(0).alias("input_index"), F.col(c).alias("input_text"))
    rest = F.transform(F.coalesce("recovered_questions", F.array().cast("array<string>")), lambda q, i: F.struct(F.lit("recovered").alias("input_type"), i.cast("int").alias("input_index"), q.alias("input_text")))
    return df.select(key, F.inline(F.concat(F.array(one("original", "original_question"), one("masked", "masked_question")), rest)))


# ---- multiple choice


def choice_texts(choices: Column) -> Column:
    """Map from letter to text of array<struct<choice, label_text>>; entries without either are left out, of repeated letters the last counts."""
    good = F.filter(choices, lambda c: c["choice"].isNotNull() & c["label_text"].isNotNull())
    return F.aggregate(good, F.create_map().cast("map<string,string>"), lambda m, c: F.map_concat(F.map_filter(m, lambda k, v: k != F.upper(F.trim(c["choice"]))), F.create_map(F.upper(F.trim(c["choice"])), c["label_text"])))


def chosen_output(parsed: Column, choices: Column) -> Column:
    """struct(status, letter, text): the text of the option that was parsed, never that of another."""
    letter = F.nullif(F.upper(F.trim(parsed)), F.lit(""))
    text = F.try_element_at(choice_texts(choices), letter)
    return F.struct(F.when(text.isNotNull(), "ok").otherwise("parse_failure").alias("status"), F.when(text.isNotNull(), letter).alias("letter"), text.alias("text"))


def outcome(parsed: Column, gold: Column) -> Column:
    return F.when(parsed.isNull(), "parse_failure").when(F.upper(F.trim(parsed)) == F.upper(F.trim(gold)), "correct").otherwise("wrong")


def leaked(output: Column, parsed: Column, gold: Column, choices: Column) -> Column:
    """Whether an output that answers another letter than gold has gold's text: the text came from the label, not from the answer."""
    a, b = F.upper(F.trim(parsed)), F.upper(F.trim(gold))
    return F.coalesce((a != b) & (output == F.try_element_at(choice_texts(choices), b)), F.lit(False))


# Words that negate an option.
NEGATION = r"(?i)\b(not|no|never|none|cannot|can't|without|neither|nor|un\w+|in\w*valid)\b"


def option_surface(text: Column, choices: Column, parsed: Column) -> Column:
    """struct(chars, words, has_digit, has_negation, position, length_rank) of the chosen option; -1 throughout without one.
    The rank is by length, the longest first, equal lengths share the first place."""
    lengths = F.transform(choices, lambda c: F.length(F.coalesce(c["label_text"], F.lit(""))))
    rank = 1 + F.size(F.filter(lengths, lambda n: n > F.length(text)))
    letters = F.array_sort(F.map_keys(choice_texts(choices)))
    place = F.array_position(letters, F.upper(F.trim(parsed))) - 1
    values = {
        "chars": F.length(text), "words": F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), "has_digit": text.rlike(r"\d").cast("int"), "has_negation": text.rlike(NEGATION).cast("int"),
        "position": F.coalesce(place, F.lit(-1)), "length_rank": F.when(F.array_contains(lengths, F.length(text)), rank).otherwise(-1),
    }
    has = F.coalesce(F.length(text) > 0, F.lit(False))
    return F.struct(*[F.when(has, v).otherwise(-1).cast("double").alias(n) for n, v in values.items()])


# ---- identifiers

# How an identifier is asked for.
FAMILY_TEXT = {"attack": "MITRE ATT&CK technique or sub-technique", "cwe": "CWE weakness", "cve": "CVE record"}


def recall_question(family: Column, ident: Column, name: Column, description: Column) -> Column:
    """A question that asks for an identifier by its name and description, from which the identifier itself is removed."""
    title, body = X.without_id(F.coalesce(name, F.lit("")), ident), X.without_id(F.coalesce(description, F.lit("")), ident)
    parts = F.array_compact(F.array(F.when(title != "", F.concat(F.lit("Title/name: "), title, F.lit("."))), F.when(body != "", F.concat(F.lit("Description: "), body))))
    evidence = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("The ontology entry has minimal public metadata.")
    kind = F.lit(FAMILY_TEXT["cve"])
    for k in ("attack", "cwe"):
        kind = F.when(family == k, FAMILY_TEXT[k]).otherwise(kind)
    # The wording of the question
    return F.concat(F.lit("A public cybersecurity ontology entry is described below.\n\n"), evidence, F.lit("\n\nWhich "), kind, F.lit(" identifier does this entry correspond to? Answer with the identifier string only, then briefly explain your reasoning."))


def asks_itself(question: Column, ident: Column) -> Column:
    """Whether a question names the identifier that it asks for: as a mention, or letter for letter where its number is longer than
    the patterns of mentions allow. An identifier within a longer one is not named."""
    found = lambda q: F.array_contains(F.transform(X.identifiers(q), lambda m: m["normalized"]), ident)
    literal = lambda q: F.rlike(q, F.concat(F.lit(r"(?<![A-Za-z0-9-])\Q"), ident, F.lit(r"\E(?![A-Za-z0-9]|\.\d)")))
    # an array of one binds the question, which would else be made anew for every pattern
    return F.transform(F.array(question), lambda q: F.when(q.isNotNull(), F.when(F.contains(q, ident), literal(q)).otherwise(F.lit(False)) | found(q)))[0]


def agreement(target: Column, ids: Column) -> Column:
    """Share of the filled ids that equal the target; null without any."""
    clean = F.filter(ids, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.when(F.size(clean) > 0, F.size(F.filter(clean, lambda x: x == target)) / F.size(clean))


def primary(family: Column, label: Column, families: tuple[str, ...] = ("attack", "cwe")) -> Column:
    """Mentions that the primary detection task counts."""
    return F.coalesce(family.isin(*families) & label.isin("grounded", "fabricated"), F.lit(False))


def surface_format(text: Column, mentions: Column) -> Column:
    """struct of what a completion looks like: length, lines, mentions by family, list shape, first place of an id (-1 without one).
    Mentions are array<struct<family, label, granularity, start>>; echoed ones don't count."""
    text = F.coalesce(text, F.lit(""))
    said = F.filter(F.coalesce(mentions, F.array()), lambda m: m["label"].isin("grounded", "fabricated"))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"))
    count = lambda test: F.size(F.filter(said, test))
    values = {
        "chars": F.length(text), "lines": F.size(lines), "mentions": F.size(said), "attack": count(lambda m: m["family"] == "attack"), "cwe": count(lambda m: m["family"] == "cwe"), "cve": count(lambda m: m["family"] == "cve"),
        "subtechnique": (count(lambda m: m["granularity"] == "subtechnique") > 0).cast("int"), "list": (F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*]"))) >= 3).cast("int"),
        "first": F.coalesce(F.array_min(F.transform(said, lambda m: m["start"])), F.lit(-1)),
    }
    return F.struct(*[v.cast("double").alias(n) for n, v in values.items()])
