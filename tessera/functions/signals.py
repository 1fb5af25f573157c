"""Signals of a model's outputs as expressions: effect sizes, readouts at layers, fixed risk scores, attention over positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


def or_zero(x: Column) -> Column:
    return F.coalesce(V.finite(x), F.lit(0.0))


def output_shift(kl: Column, js: Column, top_changed: Column, overlap: Column, logprob_delta: Column) -> Column:
    """How far an output moved, as one number: divergences, a changed first token, lost overlap and lost probability, each bounded."""
    drop = F.greatest(F.lit(0.0), -or_zero(logprob_delta))
    # Weights of the parts
    return or_zero(js) + 0.5 * F.least(or_zero(kl), F.lit(5.0)) + 0.5 * or_zero(top_changed) + 0.5 * (1.0 - or_zero(overlap)) + 0.25 * F.least(drop, F.lit(5.0))


def readout(xs: Column) -> Column:
    """struct(margin, entropy, top) of a distribution: the lead of the largest value, the entropy, and where the largest is."""
    return F.struct(V.top_two_margin(xs).alias("margin"), V.entropy(xs).alias("entropy"), (F.array_position(xs, F.array_max(xs)) - 1).cast("int").alias("top"))


def across_layers(low: Column, high: Column, final: Column) -> Column:
    """struct comparing distributions read at two layers and at the end."""
    a, b = readout(low), readout(high)
    return F.struct(
        a["margin"].alias("margin_low"), a["entropy"].alias("entropy_low"), b["margin"].alias("margin_high"), b["entropy"].alias("entropy_high"), V.js(low, high).alias("disagreement"), (a["top"] != b["top"]).cast("double").alias("flip"), V.kl(final, high).alias("final_kl"),
    )


def null_skipping_mean(*values: Column) -> Column:
    """Mean of those values that are finite; null without any."""
    clean = F.filter(F.array(*[V.finite(v) for v in values]), lambda v: v.isNotNull())
    return F.when(F.size(clean) > 0, V.total(clean) / F.size(clean))


def fixed_risk(margin: Column, entropy: Column, consistency: Column, agrees: Column) -> Column:
    """A risk that needs no fit: low margin, high entropy, low consistency, disagreement with the majority."""
    return null_skipping_mean(-margin, entropy, 1.0 - consistency, 1.0 - agrees)


def hidden_fragility(norm: Column, shift: Column, slope: Column, similarity: Column) -> Column:
    return F.coalesce(null_skipping_mean(norm, shift, F.abs(or_zero(slope)), 1.0 - or_zero(similarity)), F.lit(0.0))


def harmed(top_changed: Column, entropy_delta: Column, margin_delta: Column) -> Column:
    """Whether steering did harm: another first token, much more entropy, or much less margin."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return (zero(top_changed) > 0) | (zero(entropy_delta) > 1.0) | (zero(margin_delta) < -0.25)


def rank_of(scores: Column, target: Column, among: Column) -> Column:
    """1 and the number of candidates whose finite score is above the target's; null without a finite one. scores is a map by token id."""
    own = V.finite(F.try_element_at(scores, target))
    better = F.filter(among, lambda c: F.coalesce(V.finite(F.try_element_at(scores, c)) > own, F.lit(False)))
    return F.when(own.isNotNull(), 1 + F.size(better))


def hidden_index(layers: Column, depth: float = 0.7) -> Column:
    """struct(block, tuple_index): the block at a relative depth, and its place in a list that begins with the embedding."""
    block = F.greatest(F.lit(0), F.least(F.floor(F.lit(float(depth)) * layers).cast("int"), (layers - 1).cast("int")))
    return F.struct(block.alias("block"), (block + 1).alias("tuple_index"))


def projected(vector: Column, rows: list[list[float]]) -> Column:
    """Scores of a vector on each of a list of weight rows, which become part of the plan: a bounded table such as the rows of answer options."""
    return F.array(*[V.dot(vector, F.array(*[F.lit(float(x)) for x in r])) for r in rows])


def lead(auroc: Column) -> Column:
    """2 A - 1: how far scores separate two classes, from -1 to 1."""
    return 2.0 * auroc - 1.0


def observability(auroc: Column) -> Column:
    """The lead, 0 at least; NaN is refused."""
    return F.when(F.isnan(auroc), F.raise_error(F.lit("AUROC is not a number"))).otherwise(F.greatest(F.lit(0.0), lead(auroc)))


def choice_status(text: Column) -> Column:
    """A label of an entailment model as one of three words; null for others."""
    word = F.lower(F.trim(text))
    return F.when(word.contains("contradict"), "contradiction").when(word.contains("entail"), "entailment").when(word.contains("neutral"), "neutral")


def stub_vector(token: Column, layer: Column, width: int) -> Column:
    """A repeatable stand-in for a hidden vector: numbers in [-1, 1) that depend on token, layer and place alone."""
    cell = lambda i: ((token * 31 + layer * 17 + i * 7) % 97) / 48.5 - 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: cell(i).cast("double"))
