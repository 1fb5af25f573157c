"""Ordered decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import number_values

# Scores of the rule-based entailment scorer, (entailment, neutral, contradiction).
ENTAILMENT = {
    ("generalize", "forward"): (0.75, 0.20, 0.05),
    ("generalize", "backward"): (0.35, 0.60, 0.05),
    ("delete", "forward"): (0.55, 0.40, 0.05),
    ("delete", "backward"): (0.25, 0.70, 0.05),
}
# Risk of a recoverability label, and bands of risk by bucket.
RISK = {"Misleading Recovery": 1.0, "Non-recoverable": 0.75, "Partially Recoverable": 0.50, "Recoverable": 0.25}
BANDS = {0: (0.00, 0.20), 1: (0.30, 0.50), 2: (0.55, 0.75), 3: (0.80, 1.00)}


def table(values: dict, key: Column) -> Column:
    """A value looked up in a fixed table, null without an entry."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def entailment(kind: Column, spans: Column, direction: str) -> Column:
    """struct(entailment, neutral, contradiction, label) of the rule-based scorer; more spans cost up to 0.2."""
    cost = F.least(F.lit(0.20), F.lit(0.05) * (spans - 1))

    def base(i: int) -> Column:
        return F.when(kind == "generalize", ENTAILMENT["generalize", direction][i]).when(kind == "delete", ENTAILMENT["delete", direction][i])

    e, n, c = F.round(base(0) - cost, 10), F.round(base(1) + cost, 10), base(2)
    label = F.when((e >= n) & (e >= c), "entailment").when(n >= c, "neutral").otherwise("contradiction")
    return F.struct(e.alias("entailment"), n.alias("neutral"), c.alias("contradiction"), label.alias("label"))


def necessity(forward: Column, backward: Column, contradiction: Column, *, equivalent: float = 0.70, directional: float = 0.50, against: float = 0.50) -> Column:
    """struct(label, reason, score) of a pair of entailment scores."""
    both = F.least(forward, backward)
    label = (
        F.when(contradiction >= against, "Non-equivalent").when(both >= equivalent, "Equivalent").when((forward >= directional) & (backward < directional), "Information Loss")
        .when((forward < directional) & (backward >= directional), "Added Assumption").otherwise("Non-equivalent")
    )
    reason = (
        F.when(contradiction >= against, "contradiction above threshold").when(both >= equivalent, "bidirectional entailment above equivalent threshold")
        .when((forward >= directional) & (backward < directional), "forward entails ablated but backward does not entail original")
        .when((forward < directional) & (backward >= directional), "backward entails original but forward does not entail ablated").otherwise("low bidirectional entailment")
    )
    return F.struct(label.alias("label"), reason.alias("reason"), F.round(F.greatest(1 - both, contradiction), 10).alias("score"))


def recovery_sample(both: Column, contradiction: Column, *, full: float = 0.70, partial: float = 0.50, against: float = 0.50) -> Column:
    """struct(label, score, confidence, misleading) of one recovery by its entailment scores."""
    label = F.when(contradiction >= against, "Misleading Recovery").when(both >= full, "Recoverable").when(both >= partial, "Partially Recoverable").otherwise("Non-recoverable")
    score = F.when(contradiction >= against, F.round(F.greatest(F.lit(0.0), 1 - contradiction), 10)).otherwise(both)
    confidence = F.when(contradiction >= against, contradiction).when(both >= partial, both).otherwise(F.round(F.greatest(1 - both, contradiction), 10))
    return F.struct(label.alias("label"), score.alias("score"), confidence.alias("confidence"), (contradiction >= against).alias("misleading"))


def exact_recovery(samples: Column, exact: Column, wrong: Column) -> Column:
    """Recoverability label from counts of samples, exact matches and non-empty mismatches."""
    return F.when(exact == samples, "Recoverable").when(exact > 0, "Partially Recoverable").when(wrong > 0, "Misleading Recovery").otherwise("Non-recoverable")


def anchor(semantic: Column, recoverability: Column, misleading: Column, *, semantic_weight: float = 0.6, risk_weight: float = 0.4) -> Column:
    """struct(score, label) of an anchor from its necessity score and its recoverability."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(semantic_weight * semantic + risk_weight * table(RISK, recoverability), 10)))
    label = F.when(misleading | (recoverability == "Misleading Recovery"), "Risky Anchor").when(score >= 0.75, "Strong Anchor").when(score >= 0.55, "Medium Anchor").when(score >= 0.35, "Weak Anchor").otherwise("Distractor")
    return F.struct(score.alias("score"), label.alias("label"))


def votes(necessary: Column, total: Column) -> Column:
    """Three-way vote over the records of a unit."""
    return F.when(necessary == 0, "no_semantic_necessity_evidence").when(necessary == total, "consistent_semantic_necessity_evidence").otherwise("mixed_semantic_necessity_evidence")


def direction(text: Column) -> Column:
    """more, less or equal: by the whole phrase, else by a phrase it holds."""
    norm = F.lower(F.trim(text))
    whole = F.coalesce(*[F.when(norm.isin(words), F.lit(g)) for g, words in L.DIRECTIONS.items()])
    held = F.coalesce(*[F.when(norm.rlike("|".join(rf"\b{w}\b" for w in words)), F.lit(g)) for g, words in L.DIRECTIONS.items()])
    return F.coalesce(whole, held)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-z0-9$%.,'-]+"), F.lit(0))


def singular(word: Column) -> Column:
    w, n = F.lower(F.trim(word)), F.length(F.trim(word))
    return F.when(F.endswith(w, F.lit("ies")) & (n > 3), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when(F.endswith(w, F.lit("es")) & (n > 2), F.substring(w, F.lit(1), n - 2)).when(F.endswith(w, F.lit("s")) & (n > 1), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def drift(span: Column, kind: Column, fill: Column, uncertain: Column) -> Column:
    """How the fill of a masked span drifted from the span, by the span's type."""
    s, f = F.trim(F.coalesce(span, F.lit(""))), F.trim(fill)
    sl, fl = F.lower(s), F.lower(f)
    count = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    generic = F.regexp_replace(fl, r"^\.+|\.+$", "").isin(L.GENERIC_QUANTITIES)
    sv, fv = number_values(s), number_values(f)
    numeric = (F.size(sv) > 0) & (F.size(fv) > 0)
    equal = F.exists(sv, lambda a: F.exists(fv, lambda b: F.abs(a - b) <= 1e-6))
    ds, df = direction(s), direction(f)
    sw, fw = F.array_distinct(words(s)), F.array_distinct(words(f))
    negative = lambda x, w: F.arrays_overlap(w, F.array(*[F.lit(n) for n in L.NEGATIONS])) | F.contains(x, F.lit("n't"))
    units = lambda x, w: F.array_sort(F.array_union(F.array_intersect(w, F.array(*[F.lit(u) for u in L.UNITS])), F.array_compact(F.array(F.when(F.contains(x, F.lit("%")), F.lit("%")), F.when(F.contains(x, F.lit("$")), F.lit("$"))))))
    su, fu = units(sl, sw), units(fl, fw)
    held = (F.size(sw) > 0) & (F.size(fw) > 0) & ((F.size(F.array_except(sw, fw)) == 0) | (F.size(F.array_except(fw, sw)) == 0))
    return (
        F.when(uncertain, "unrecoverable").when(fill.isNull(), "ambiguous").when(f == "", "unrecoverable").when(F.contains(fl, F.lit("mask]")), "ambiguous")
        .when(count(f) > F.greatest(F.lit(8), 4 * F.greatest(F.lit(1), count(s))), "ambiguous").when(fl == sl, "exact_recovery")
        .when((count(f) == 1) & (count(s) == 1) & (singular(f) == singular(s)), "exact_recovery")
        .when((kind == "number") & numeric & equal, "exact_recovery").when((kind == "number") & numeric, "wrong_numeric_recovery").when(kind == "number", "generic_recovery")
        .when((kind == "comparison") & ds.isNotNull() & df.isNotNull(), F.when(ds == df, "exact_recovery").otherwise("direction_drift")).when(kind == "comparison", "generic_recovery")
        .when(kind == "negation", F.when(negative(sl, sw) == negative(fl, fw), "exact_recovery").otherwise("direction_drift"))
        .when((F.size(su) > 0) & (su != fu), "unit_drift")
        .when(kind.isin("object", "entity"), F.when(generic | fl.isin(L.VAGUE_OBJECTS) | held, "generic_recovery").otherwise("object_drift"))
        .when(kind == "condition", "condition_drift").otherwise("generic_recovery")
    )


HARD_DRIFT = ["wrong_numeric_recovery", "direction_drift", "unit_drift", "object_drift", "condition_drift"]


def bucket(kind: Column, status: Column, hard: Column, majority: Column, generic: Column, unrecoverable: Column, exact: Column, samples: Column) -> Column:
    """Fragility bucket 0 to 3, null for what is excluded."""
    half = F.greatest(F.lit(1), F.floor(samples / 2).cast("int"))
    return (
        F.when((kind == "number") & (status == "ambiguous_number"), None).when((kind == "number") & (status == "off_solution_path_number"), 0).when(hard, 3)
        .when((generic >= half) | (majority == "generic_recovery"), 2).when((unrecoverable >= half) | (majority == "unrecoverable"), 2).when(exact >= 1, 1).otherwise(2)
    )


def risk_strength(bucket_: Column, instability: Column) -> Column:
    """A strength inside the bucket's band, by instability in 0 to 1."""
    low, high = table({k: v[0] for k, v in BANDS.items()}, bucket_), table({k: v[1] for k, v in BANDS.items()}, bucket_)
    return F.round(low + (high - low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), instability)), 6)


def margin(scores: Column, chosen: Column) -> Column:
    """The chosen score less the best other one."""
    return F.element_at(scores, chosen) - F.array_max(F.map_values(F.map_filter(scores, lambda k, v: k != chosen)))


def verdict(low: Column, high: Column, width: float = 0.1) -> Column:
    """What an interval of a difference says."""
    return F.when(low.isNull() | high.isNull(), "undetermined").when(low > 0, "positive").when(high < 0, "negative").when(high - low <= width, "equivalent").otherwise("imprecise")
