"""Spans of a text: extraction by lexicon, units of spans, ablated and masked texts, span samples."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions import text as X

SPANS = "array<struct<span_id:string,text:string,type:string,start:int,end:int>>"


def _typed(found: Column, kind: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), kind.alias("type"), m["start"].alias("start"), m["end"].alias("end"))).cast(X.SPAN)


def _listed(lexicon: dict[str, list[str]], of) -> Column:
    """An array literal of (type, phrase as `of` writes it): the lexicon is data of one expression, not an expression each."""
    return F.array(*[F.struct(F.lit(k).alias("type"), F.lit(of(p)).alias("phrase"), F.lit(p.lower()).alias("plain")) for k, ps in lexicon.items() for p in ps])


def candidates(text: Column, *, setting: str = "auto", most: int = 20) -> Column:
    """Candidate spans of a text: numbers, lexicon phrases (English ones as whole words in any case, Chinese ones wherever
    they stand) and words after numbers. Equal (start, end, type) count once; the most wanted `most` stay, in text order,
    with ids span_001 and on."""
    parts = [_typed(X.matches(text, L.ARABIC_NUMBER), "number"), _typed(X.matches(text, L.CHINESE_NUMBER), "number")]
    if setting != "zh":
        # a phrase that a text does not hold in any case needs no search by its pattern
        listed = _listed(L.ENGLISH, lambda p: rf"(?i)(?<![A-Za-z0-9_]){re.escape(p)}(?![A-Za-z0-9_])")
        english = X.bound(F.lower(text), lambda low: F.filter(listed, lambda e: F.contains(low, e["plain"])))
        parts.append(F.flatten(F.transform(english, lambda e: _typed(X.matches(text, e["phrase"]), e["type"]))))
        stop = [p.lower() for k in ("question_target", "comparison", "negation", "condition", "operation") for p in L.ENGLISH[k]]
        parts.append(F.filter(_typed(X.matches(text, L.NUMBER_NEIGHBOUR, 1), "object"), lambda s: ~F.lower(s["text"]).isin(stop)))
    if setting != "en":
        chinese = F.flatten(F.transform(_listed(L.CHINESE, str), lambda e: _typed(X.occurrences(text, e["phrase"]), e["type"])))
        parts.append(chinese if setting == "zh" else F.when(X.has_cjk(text), chinese).otherwise(F.array().cast(X.SPAN)))
    whole = F.array_distinct(F.concat(*parts))
    order = F.create_map(*[F.lit(x) for i, t in enumerate(L.SPAN_PRIORITY) for x in (t, i)])
    ranked = F.array_sort(F.transform(whole, lambda s: F.struct(F.coalesce(F.try_element_at(order, s["type"]), F.lit(100)).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["type"].alias("type"))))
    kept = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"))))
    return F.transform(kept, lambda s, i: F.struct(F.format_string("span_%03d", i + 1).alias("span_id"), s["text"].alias("text"), s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPANS)


def _of_type(kind: str):
    return lambda s: s["type"] == kind


UNITS = f"array<struct<unit_scope:string,group_type:string,span_ids:array<string>,spans:{SPANS},reason:string>>"
# Span types that make a group of their own.
TYPE_SETS = {"number": "number_set", "entity": "entity_set", "object": "object_set", "cyber_security_term": "cyber_security_term_set"}
# Order of group types.
GROUP_ORDER = ["repeated_surface", "number_set", "entity_set", "object_set", "cyber_security_term_set"]


def units(spans: Column, *, most_spans: int = 5, most_groups: int = 10) -> Column:
    """Units of spans: every span alone, then groups of equal texts and of equal types with two spans or more.

    A group holds its first `most_spans` spans; groups of the same spans count once, by the order of group types; the
    first `most_groups` stay."""
    ordered_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span_id"].alias("span_id"), s["text"].alias("text"), s["type"].alias("type"))))

    def made(ordered: Column) -> Column:
        back = lambda xs: F.transform(xs, lambda s: F.struct(s["span_id"].alias("span_id"), s["text"].alias("text"), s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end")))

        def unit(scope: str, kind: Column, members: Column, reason: Column) -> Column:
            return F.struct(F.lit(scope).alias("unit_scope"), kind.alias("group_type"), F.transform(members, lambda s: s["span_id"]).alias("span_ids"), back(members).alias("spans"), reason.alias("reason"))

        single = F.transform(ordered, lambda s: unit("single", F.lit("single"), F.array(s), F.lit("single candidate span"))).cast(UNITS)
        texts = F.array_distinct(F.transform(ordered, lambda s: s["text"]))
        same = F.transform(texts, lambda t: unit("group", F.lit("repeated_surface"), F.slice(F.filter(ordered, lambda s: s["text"] == t), 1, most_spans), F.lit("same surface text appears multiple times"))).cast(UNITS)
        kinds = F.array(*[unit("group", F.lit(g), F.slice(F.filter(ordered, _of_type(k)), 1, most_spans), F.lit(f"all {k} spans in the question")) for k, g in TYPE_SETS.items()]).cast(UNITS)
        groups = F.filter(F.concat(same, kinds), lambda u: F.size(u["span_ids"]) >= 2)
        rank = F.create_map(*[F.lit(x) for i, g in enumerate(GROUP_ORDER) for x in (g, i)])
        keyed = F.array_sort(F.transform(groups, lambda u: F.struct(F.element_at(rank, u["group_type"]).alias("p"), u["spans"][0]["start"].alias("at"), u["span_ids"].alias("ids"), u.alias("u"))))
        first = F.aggregate(keyed, F.array().cast(UNITS), lambda acc, k: F.when(F.exists(acc, lambda u: u["span_ids"] == k["ids"]), acc).otherwise(F.array_append(acc, k["u"])).cast(UNITS))
        return F.concat(single, F.slice(first, 1, most_groups))

    # the spans in order are used by every group, so they are worked out once
    return X.bound(ordered_, made)


def with_units(df: DataFrame, text: str, **limits) -> DataFrame:
    """df with `spans` and `units` of a text column; two projections, so that spans are found once."""
    return df.withColumn("spans", candidates(F.col(text))).withColumn("units", units(F.col("spans"), **limits))


def ablations(df: DataFrame, text: str, unit_column: str, kinds: tuple[str, ...] = ("delete", "generalize"), setting: str = "auto") -> DataFrame:
    """One row per unit and kind: `kind`, `ablated` and `status` (kept, overlap, empty, unchanged)."""
    rows = df.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    spans = F.col(unit_column)["spans"]
    made = F.lit(None).cast("string")
    for k in kinds:
        made = F.when(F.col("kind") == k, X.ablated(F.col(text), spans, k, setting)).otherwise(made)
    rows = rows.withColumn("overlap_", X.overlapping(spans)).withColumn("ablated", F.when(~F.col("overlap_"), made))
    status = F.when(F.col("overlap_"), "overlap").when(F.col("ablated") == "", "empty").when(F.col("ablated") == F.col(text), "unchanged").otherwise("kept")
    return rows.withColumn("status", status).drop("overlap_")


# Span types that are kept first, and those that come next, in this order.
NUMERIC = {"number", "number_unit", "rate"}
FAMILIES = ["comparison", "negation", "condition", "operation", "question_target"]


def _mixed(spans: list, most: int) -> list:
    """At most `most` of spans in order of priority: numeric ones, then every family's, one object, then what is left."""
    if len(spans) <= most:
        return spans
    family = {t: i for i, t in enumerate(FAMILIES)}
    first = next((i for i, s in enumerate(spans) if s.type == "object"), None)
    turn = lambda i, s: 0 if s.type in NUMERIC else 1 + family[s.type] if s.type in family else len(family) + (1 if i == first else 2)
    return [s for _, s in sorted(enumerate(spans), key=lambda x: (turn(*x), x[0]))][:most]


# Priority of a span type where spans overlap, the least first; other types come last, at 99.
PRIORITY = {"rate": 5, "number_unit": 8, "number": 10, "question_target": 20, "comparison": 30, "negation": 40, "condition": 45, "operation": 50, "object": 80}


class Span(NamedTuple):
    """A span with its priority."""

    start: int
    end: int
    type: str
    text: str
    p: int


def unoverlapped(df: DataFrame, by: str, *, most: int = 12) -> DataFrame:
    """For rows (by, start, end, type, text): the spans that remain where spans overlap. Spans are taken in the order of
    the text (start, end, priority). A span goes when one that was kept before overlaps it and has a better priority, or
    the same priority and no lesser length; a number and a span of another type, one inside the other, both stay. At most
    `most` spans a text: numbers first, then comparisons, negations, conditions, operations, question targets, one object,
    and others by priority. Rows with the same (start, end, type) count once; an unknown type has the last priority.

    Each decision depends on those before, so a text's spans, which are few, are gathered in a list and looked at in plain Python;
    a call of Python sees the lists of many texts."""
    fields = ["start", "end", "type", "text"]
    kind = T.ArrayType(df.select(*fields).schema)

    def run(cells: list) -> list[dict]:
        seen, kept = set(), []
        word = lambda x: (x is None, x or "")
        for r in sorted((Span(c["start"], c["end"], c["type"], c["text"], PRIORITY.get(c["type"], 99)) for c in cells), key=lambda r: (r.start, r.end, r.p, word(r.type), word(r.text))):
            if (r.start, r.end, r.type) in seen:
                continue
            seen.add((r.start, r.end, r.type))
            rivals = [t for t in kept if r.start < t.end and t.start < r.end]
            nested = lambda t: (r.type == "number") != (t.type == "number") and (t.start <= r.start and r.end <= t.end or r.start <= t.start and t.end <= r.end)  # noqa: E731, B023
            if not any((t.p, t.start - t.end) <= (r.p, r.start - r.end) for t in rivals if not nested(t)):
                kept.append(r)
        out = _mixed(sorted(kept, key=lambda t: (t.p, t.start, t.end)), most)
        return [{f: getattr(t, f) for f in fields} for t in sorted(out, key=lambda t: (t.start, t.end, word(t.type)))]

    @F.pandas_udf(kind)
    def thinned(cells: pd.Series) -> pd.Series:
        return cells.map(run)

    held = df.groupBy(by).agg(F.collect_list(F.struct(*fields)).alias("spans_"))
    return held.select(by, F.inline(thinned("spans_")))


def family_candidates(text: Column) -> Column:
    """Candidate spans of a question by family: rates, numbers with units, numbers as digits and words, question targets,
    comparisons, negations, conditions, operations, and objects (words after numbers, capitalized words, plurals). Spans
    may overlap, and equal ones count once. Every pattern begins and ends with a letter, a digit or %, so there are no
    marks to trim. Null text has no spans."""
    phrase = lambda p: rf"(?i)\b(?:{'|'.join(p)})\b"
    object_ = lambda pattern, group=0: F.filter(_typed(X.matches(text, pattern, group), "object"), lambda s: ~F.lower(s["text"]).isin(L.NO_OBJECTS))
    counted = F.filter(X.matches(text, L.NUMBER_UNIT_PHRASE), lambda m: ~F.lower(F.split(m["text"], r"\s+")[1]).isin(L.NO_OBJECTS))
    rate = lambda m: F.arrays_overlap(F.split(F.lower(m["text"]), r"\s+"), F.array(F.lit("each"), F.lit("per"), F.lit("apiece")))
    with_unit = F.transform(counted, lambda m: F.struct(m["text"].alias("text"), F.when(rate(m), "rate").otherwise("number_unit").alias("type"), m["start"].alias("start"), m["end"].alias("end"))).cast(X.SPAN)
    parts = [
        _typed(X.matches(text, L.RATE_PHRASE), "rate"), with_unit, _typed(X.matches(text, L.ARABIC_NUMBER), "number"), _typed(X.matches(text, L.NUMBER_WORD), "number"),
        *[_typed(X.matches(text, phrase(p)), kind) for kind, p in L.FAMILY_PHRASES.items()], object_(L.COUNTED_WORD, 1), object_(L.CAPITALIZED_WORD), object_(L.PLURAL_WORD),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast(X.SPAN))


def families(df: DataFrame, by: str, text: str, *, most: int = 12) -> DataFrame:
    """Rows (by, span_id, type, start, end, text, overlap_group, parent) of the questions of df, one row a value of `by`:
    candidates by family, thinned where they overlap (`unoverlapped`) and numbered in text order from span_000.
    overlap_group numbers from 1 the chains of two overlapping spans or more, in text order, and is null for a span alone;
    parent is the longest span of the group (of equal ones the better priority, then the first) where it holds the span."""
    from pyspark.sql import Window

    rows = df.select(by, F.inline(family_candidates(F.col(text))))
    kept = unoverlapped(rows, by, most=most)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("type")), F.lit(99))
    numbered = kept.withColumn("rank_", rank).withColumn("span_id", F.format_string("span_%03d", F.row_number().over(Window.partitionBy(by).orderBy("start", "end", "rank_", "type")) - 1))
    grouped = parents(numbered, by, rank="rank_")
    many = F.count(F.lit(1)).over(Window.partitionBy(by, "overlap_group")) > 1
    dense = grouped.withColumn("chain_", F.when(many, F.col("overlap_group")))
    group = F.when(F.col("chain_").isNotNull(), F.dense_rank().over(Window.partitionBy(by).orderBy(F.col("chain_").asc_nulls_last())))
    return dense.select(by, "span_id", "type", "start", "end", "text", group.alias("overlap_group"), "parent")


def parents(df: DataFrame, by: str, rank: str | None = None) -> DataFrame:
    """df of spans (by, span_id, start, end) with overlap_group and parent: spans that chain by overlapping share a group
    (gaps and islands); the parent is the longest span that contains a span, null for the longest itself. Of equally long
    ones the least `rank` counts, where one is given, then the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("start", F.desc("end"), "span_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new_", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    grouped = marked.withColumn("overlap_group", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    g = Window.partitionBy(by, "overlap_group")
    longest = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col(rank) if rank else F.lit(0)).alias("r"), (-F.col("start")).alias("s"), F.col("span_id").alias("id"), F.col("end").alias("e"))).over(g)
    out = grouped.withColumn("l_", longest)
    inside = (F.col("span_id") != F.col("l_")["id"]) & (F.col("start") >= -F.col("l_")["s"]) & (F.col("end") <= F.col("l_")["e"])
    return out.withColumn("parent", F.when(inside, F.col("l_")["id"])).drop("l_")


def filled_holes(df: DataFrame, key: str, template: str, text: str, token: str = "[MASK]") -> DataFrame:
    """(key, hole, start, end, fill) of the holes of templates that their texts fit, one row a hole; texts that don't fit, or that leave
    a hole empty, have none."""
    found = X.template_fills(F.col(template), F.col(text), token)
    rows = df.select(key, found.alias("f_")).where("f_.status = 'ok'").select(key, F.explode("f_.fills").alias("h_"))
    return rows.select(key, "h_.hole", "h_.start", "h_.end", F.col("h_.text").alias("fill"))
