"""String functions over columns: matches with offsets, splicing, normal forms, answers, identifiers.

Offsets count code points, start inclusive and end exclusive. All are built-in expressions; none needs a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

MATCH = "array<struct<text:string,start:int,end:int>>"
SPAN = "array<struct<text:string,type:string,start:int,end:int>>"


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches of a pattern with their offsets; null text gives null.

    The parts between matches give the offsets: match i starts where the parts up to i and the matches
    before i end. With group=1 the group's text is located at the end of the match, so the pattern must end
    with the group. The pattern may be a column, such as an element of an array of patterns."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, pattern, F.lit(-1))
    rows = F.arrays_zip(whole.alias("m"), parts.alias("gap")) if not group else F.arrays_zip(whole.alias("m"), parts.alias("gap"), F.regexp_extract_all(text, pattern, F.lit(group)).alias("k"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(state: Column, x: Column) -> Column:
        end = (state["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("int")
        kept = x["k"] if group else x["m"]
        found = F.struct(kept.alias("text"), (end - F.length(kept)).cast("int").alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), state["out"]).otherwise(F.array_append(state["out"], found)).cast(MATCH).alias("out"))

    return F.aggregate(rows, empty, step)["out"]


def occurrences(text: Column, phrase: str | Column) -> Column:
    """All occurrences of a phrase, overlapping ones too, with offsets."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    size = F.length(phrase)
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0))), lambda i: F.substring(text, i + 1, size) == phrase)
    spans = F.transform(found, lambda i: F.struct(phrase.alias("text"), i.cast("int").alias("start"), (i + size).cast("int").alias("end")))
    return F.when(F.contains(text, phrase), spans.cast(MATCH)).otherwise(F.array().cast(MATCH))


def has_cjk(text: Column) -> Column:
    return text.rlike(L.CJK)


def language(text: Column, setting: str = "auto") -> Column:
    """zh when the text has a CJK ideograph, else en; a fixed setting wins."""
    return F.when(has_cjk(text), F.lit("zh")).otherwise(F.lit("en")) if setting == "auto" else F.lit(setting)


def collapsed(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def normal(text: Column) -> Column:
    """Lower case of the collapsed text, for comparisons."""
    return F.lower(collapsed(text))


def tidy(text: Column) -> Column:
    """Collapse white space, none before punctuation or around CJK punctuation."""
    out = F.regexp_replace(text, r"\s+", " ")
    out = F.regexp_replace(out, r"\s+([,.;:!?])", "$1")
    out = F.regexp_replace(out, r"\s*([，。！？；：、])\s*", "$1")
    return F.trim(out)


def splice(text: Column, spans: Column, replacement) -> Column:
    """Replace each span (start, end) of the text; replacement maps a span to a Column. Spans must not overlap. The gaps between spans are
    cut out of the text once each and joined with what replaces the spans; a null replacement makes the whole null."""
    made = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), replacement(s).alias("by"))))

    def joined(b: Column) -> Column:
        end_before = lambda i: F.when(i > 0, F.get(b["o"], i - 1)["end"]).otherwise(0)
        parts = F.transform(b["o"], lambda s, i: F.concat(F.substring(b["t"], end_before(i) + 1, s["start"] - end_before(i)), s["by"]))
        rest = F.substring(b["t"], end_before(F.size(b["o"])) + 1, F.length(b["t"]))
        return F.when(b["t"].isNotNull() & ~F.exists(b["o"], lambda s: s["by"].isNull()), F.array_join(F.concat(parts, F.array(rest)), ""))

    # an array of one binds text and sorted spans, which would else be worked out again for every span
    return F.transform(F.array(F.struct(text.alias("t"), made.alias("o"))), joined)[0]


def masked(text: Column, spans: Column, token: str = "[MASK]") -> Column:
    return splice(text, spans, lambda s: F.lit(token))


def ablated(text: Column, spans: Column, kind: str, setting: str = "auto") -> Column:
    """Delete the spans, or put a general phrase for their type; the result is tidied."""
    if kind == "delete":
        return tidy(splice(text, spans, lambda s: F.lit("")))
    tables = {"en": (L.GENERAL_ENGLISH, "some information"), "zh": (L.GENERAL_CHINESE, "某个信息")}

    def by(tongue: str):
        table, other = tables[tongue]
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return lambda s: F.coalesce(F.try_element_at(pairs, s["type"]), F.lit(other))

    if setting != "auto":
        return tidy(splice(text, spans, by(setting)))
    return tidy(F.when(has_cjk(text), splice(text, spans, by("zh"))).otherwise(splice(text, spans, by("en"))))


def overlapping(spans: Column) -> Column:
    """Whether two spans of the array overlap."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    state = F.struct(F.lit(-1).alias("last"), F.lit(False).alias("hit"))
    return F.aggregate(ends, state, lambda st, s: F.struct(F.greatest(st["last"], s["end"]).alias("last"), (st["hit"] | (s["start"] < st["last"])).alias("hit")))["hit"]


def first_mask_filled(text: Column, token: str, fill: Column) -> Column:
    """The text with the first token replaced."""
    at = F.instr(text, token)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), fill, F.substring(text, at + len(token), F.length(text)))).otherwise(text)


def cleaned_recovery(text: Column) -> Column:
    """Without a surrounding code fence and without leading labels, however often repeated."""
    out = F.trim(text)
    out = F.regexp_replace(out, r"(?s)^```(?:[a-zA-Z0-9_-]+)?\s*\n?(.*?)\n?```$", "$1")
    return F.regexp_replace(F.trim(out), r"(?i)^((recovered question|answer|output)\s*:\s*)+", "")


def final_part(text: Column) -> Column:
    """What follows the first ####, without commas; else the trimmed text."""
    parts = F.split(text, "####", 2)
    return F.when(F.contains(text, F.lit("####")), F.trim(F.replace(F.element_at(parts, -1), F.lit(","), F.lit("")))).otherwise(F.trim(text))


def final_answer(text: Column) -> Column:
    """struct(answer, method, start, end): the number of the last #### marker, else the last number."""
    marked = matches(text, r"####\s*([-+]?\d[\d,]*(?:\.\d+)?)", 1)
    plain = matches(text, r"[-+]?\d[\d,]*(?:\.\d+)?")
    last = F.when(F.size(marked) > 0, F.element_at(marked, -1)).when(F.size(plain) > 0, F.element_at(plain, -1))
    method = F.when(F.size(marked) > 0, "hash_answer_marker").when(F.size(plain) > 0, "last_number_fallback").otherwise("missing")
    return F.struct(last["text"].alias("answer"), method.alias("method"), last["start"].alias("start"), last["end"].alias("end"))


def normal_number(text: Column) -> Column:
    """A numeric answer in normal form: no commas, signs of money or percent; whole numbers without a point."""
    bare = F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit("")), r"^[$% \t\r\n.,]+|[$% \t\r\n.,]+$", "")
    value = bare.try_cast("double")
    whole = F.abs(value - F.round(value)) < 1e-9
    return F.when(F.length(F.trim(text)) == 0, None).when(value.isNull(), F.lower(bare)).when(whole, F.round(value).cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def option_answer(text: Column, labels: list[str]) -> Column:
    """struct(label, method): the last explicit `answer: X`, else a last isolated letter, of the given labels."""
    letters = "".join(labels)
    explicit = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:final\s+)?answer\s*:\s*([A-Z])\b"), F.lit(1)), lambda x: F.upper(x).isin(labels))
    trailing = F.regexp_extract(text, rf"(?is)(?<![A-Za-z])([{letters}])(?![A-Za-z])[\s.,;:!?()\[\]{{}}]*$", 1)
    label = F.when(F.size(explicit) > 0, F.upper(F.element_at(explicit, -1))).when(trailing != "", F.upper(trailing))
    method = F.when(F.size(explicit) > 0, "explicit_answer_marker").when(trailing != "", "last_isolated_label").otherwise("parse_failure")
    return F.struct(label.alias("label"), method.alias("method"))


def degeneration(text: Column, parsed: Column, tokens: Column | None = None, budget: int = 256, ratio: float = 3.0) -> Column:
    """Names of the degeneration rules that hold: a run of 30 equal characters, a unit of 6 to 40 five times over,
    no answer although the budget (in tokens, else estimated from characters) was spent."""
    spent = tokens >= 0.9 * budget if tokens is not None else F.length(text) >= 0.9 * budget * ratio
    rules = [("single_char_run", text.rlike(r"(?s)(.)\1{29,}")), ("substring_loop", text.rlike(r"(?s)(.{6,40}?)\1{4,}")), ("truncated_failure", parsed.isNull() & spent)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def list_like(text: Column) -> Column:
    """At least four lines of which half or more look like list items or identifiers."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    items = F.filter(lines, lambda x: x.rlike(r"^(?:[-*]|\d+[.)])\s+") | x.rlike(r"(?i)^(?:CVE-\d{4}-\d{4,}|CWE-\d{1,5}|T\d{4}(?:\.\d{3})?)\b"))
    return (F.size(lines) >= 4) & (F.size(items) >= 4) & (F.size(items) / F.size(lines) >= 0.5)


def stated_confidence(text: Column) -> Column:
    """struct(phrase, high, medium, low) of stated confidence."""
    found = {k: F.regexp_extract(text, p, 0) for k, p in L.CONFIDENCE.items()}
    phrase = F.coalesce(*[F.when(v != "", v) for v in found.values()])
    return F.struct(phrase.alias("phrase"), *[(v != "").cast("int").alias(k) for k, v in found.items()])


def identifiers(text: Column) -> Column:
    """Mentions of CVE, technique and CWE ids: family, raw, normalized, start, end, parent, sub_id, granularity, by place."""
    kind = "array<struct<start:int,end:int,family:string,raw:string,normalized:string,parent:string,sub_id:string,granularity:string>>"

    def of(family: str) -> Column:
        def row(m: Column) -> Column:
            raw = m["text"]
            sub = F.lit(None).cast("string")
            parent, grain = sub, F.lit(family)
            if family == "cve":
                normalized = F.upper(F.concat(F.lit("CVE-"), F.regexp_extract(raw, L.IDENTIFIERS["cve"], 1), F.lit("-"), F.regexp_extract(raw, L.IDENTIFIERS["cve"], 2)))
            elif family == "cwe":
                normalized = F.concat(F.lit("CWE-"), F.regexp_extract(raw, L.IDENTIFIERS["cwe"], 1).cast("int").cast("string"))
            else:
                normalized = raw
                parent = F.split(raw, r"\.")[0]
                sub = F.try_element_at(F.split(raw, r"\."), F.lit(2))
                grain = F.when(sub.isNotNull(), "subtechnique").otherwise("technique")
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(family).alias("family"), raw.alias("raw"), normalized.alias("normalized"), parent.alias("parent"), sub.alias("sub_id"), grain.alias("granularity"))

        return F.transform(matches(text, L.IDENTIFIERS[family]), row).cast(kind)

    return F.array_sort(F.concat(*[of(f) for f in L.IDENTIFIERS]))


def number_values(text: Column) -> Column:
    """Candidate values of a number as written: [1000.0] for $1,000, [50.0, 0.5] for 50%, [12.0] for twelve, [] for none."""
    table = F.create_map(*[x for k, v in L.WORD_NUMBERS.items() for x in (F.lit(k), F.lit(float(v)))])
    none = F.array().cast("array<double>")

    def written(raw: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[$,%]", ""), r"(?i)percent", ""))
        base = F.round(F.regexp_extract(bare, r"-?\d+(?:\.\d+)?", 0).try_cast("double"), 6)  # none is no number: null
        percent = F.contains(raw, F.lit("%")) | F.endswith(F.lower(raw), F.lit("percent"))
        return bound(base, lambda x: F.when(x.isNull(), none).when(percent, F.array_distinct(F.array(x, F.round(x / 100, 6)))).otherwise(F.array(x)))

    def values(raw: Column) -> Column:
        spoken = F.try_element_at(table, F.regexp_replace(F.lower(raw), r"^\.+|\.+$", ""))
        return F.when(raw.isNull() | (raw == ""), none).otherwise(bound(spoken, lambda x: F.when(x.isNotNull(), F.array(F.round(x, 6))).otherwise(written(raw))))

    # the text and what is found in it are named once: an expression that stands in several places is worked out in each
    return bound(F.trim(text), values)


def solution_values(text: Column) -> Column:
    """struct(operands, results): distinct numbers left and right of = in <<...>> expressions."""
    number = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
    parts = F.transform(F.regexp_extract_all(text, F.lit("<<([^>]*)>>"), F.lit(1)), lambda e: F.split(e, "=", 2))

    def numbers(side: int) -> Column:
        found = F.transform(parts, lambda p: F.coalesce(F.regexp_extract_all(F.try_element_at(p, F.lit(side)), F.lit(number), F.lit(0)), F.array().cast("array<string>")))
        return F.array_sort(F.array_distinct(F.transform(F.flatten(found), lambda x: F.round(F.replace(x, F.lit(","), F.lit("")).cast("double"), 6))))

    return F.struct(numbers(1).alias("operands"), numbers(2).alias("results"))


def near_any(values: Column, targets: Column, tolerance: float = 1e-6) -> Column:
    """Whether a value lies within the tolerance of a target."""
    return F.exists(values, lambda v: F.exists(targets, lambda t: F.abs(v - t) <= tolerance))


def path_status(values: Column, occurrences_: Column, operands: Column, results: Column) -> Column:
    """Whether a number of a question is on the path of its solution."""
    used, made = near_any(values, operands), near_any(values, results)
    return F.when(F.size(values) == 0, "off_solution_path_number").when(used & (occurrences_ > 1), "ambiguous_number").when(used, "on_solution_path_number").when(made, "ambiguous_number").otherwise("off_solution_path_number")


def implicit_numbers(text: Column) -> Column:
    """Words that imply a factor, with their start and value."""
    kind = "array<struct<start:int,word:string,value:double>>"

    def row(word: str, value: float):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(word).alias("word"), F.lit(round(value, 6)).alias("value"))

    parts = [F.transform(matches(F.lower(text), rf"\b{w}\b"), row(w, v)).cast(kind) for w, v in L.IMPLICIT_NUMBERS.items()]
    return F.array_sort(F.concat(*parts))


def tokens(text: Column) -> Column:
    """Words and marks with offsets."""
    return matches(text, r"(?U)\w+|[^\w\s]")


def token_id(token: Column) -> Column:
    """A small id that depends on the token's code points and their places."""
    points = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c, i: (i + 1) * F.ascii(c))
    return (F.aggregate(points, F.lit(0).cast("long"), lambda s, x: s + x) % 100_000 + 1).cast("int")


def filler(template: Column, text: Column, token: str = "[MASK]") -> Column:
    """What stands in text where the first token stands in the template, when the rest agrees; else null."""
    at = F.instr(template, token)
    head, tail = F.substring(template, F.lit(1), at - 1), F.substring(template, at + len(token), F.length(template))
    fits = (at > 0) & F.startswith(text, head) & F.endswith(text, tail) & (F.length(text) >= F.length(head) + F.length(tail))
    return F.when(fits, F.trim(F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))

    def counted(s: Column) -> Column:
        first = F.array_position(s, F.lit(False))
        return F.when(first > 0, first - 1).otherwise(F.size(s)).cast("int")

    return bound(same, counted)


def tolerant_filler(template: Column, text: Column, token: str = "[MASK]") -> Column:
    """The filler, also when words beside the slot differ in case or marks, or others stand further out: what is left of the text between
    the longest common beginning and end in words. Null when nothing is left, or without a slot."""
    at = F.instr(template, token)
    plain = lambda t: F.transform(t, lambda w: F.lower(F.regexp_replace(w, r"^[.,!?;:'\"]+|[.,!?;:'\"]+$", "")))
    cut = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[A-Za-z0-9$%.,'-]+"), F.lit(0))

    def middle(b: Column) -> Column:
        def without_tail(rest: Column) -> Column:
            j = _shared(F.reverse(b["tail"]), F.reverse(plain(rest)))
            return bound(j, lambda n: F.array_join(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - n, F.lit(0))), " "))

        kept = lambda i: F.slice(b["words"], i + 1, F.greatest(F.size(b["words"]) - i, F.lit(0)))
        return bound(bound(_shared(b["head"], plain(b["words"])), kept), without_tail)

    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    head, tail = plain(cut(F.substring(template, F.lit(1), at - 1))), plain(cut(F.substring(template, at + len(token), F.length(template))))
    found = bound(F.struct(head.alias("head"), tail.alias("tail"), words.alias("words")), middle)
    strict = filler(template, text, token)
    return F.when(at > 0, F.coalesce(strict, bound(found, lambda m: F.when(m != "", m))))


def overlapped_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """Indices of tokens (start, end) that overlap [start, end); empty tokens do not."""
    indexed = F.transform(offsets, lambda t, i: F.struct(i.alias("i"), t["start"].alias("s"), t["end"].alias("e")))
    return F.transform(F.filter(indexed, lambda t: (t["e"] > t["s"]) & (t["s"] < end) & (t["e"] > start)), lambda t: t["i"])


def hashed(text: Column, digits: int = 64) -> Column:
    """The first digits of the sha256 in hex."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def hashed_int(text: Column) -> Column:
    """The first eight hex digits of the sha256 as a number."""
    return F.conv(hashed(text, 8), 16, 10).cast("long")


def fingerprint(*columns: Column) -> Column:
    """sha256 of the columns as one JSON object, in the order given: equal for equal names and values, and for nothing else."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def choice_index(key: Column, seed: int, choices: int) -> Column:
    """sha1 of `seed:key`, as one big number, modulo the number of choices."""
    digits = F.transform(F.filter(F.split(F.sha1(F.concat(F.lit(f"{seed}:"), key).cast("binary")), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda s, d: ((s * 16 + d) % choices).cast("int"))


def without_id(text: Column, ident: Column) -> Column:
    """The text without an id, whatever its case, with white space collapsed."""
    return collapsed(F.regexp_replace(text, F.concat(F.lit(r"(?i)\Q"), ident, F.lit(r"\E")), F.lit(" ")))


def short(text: Column, limit: int = 700) -> Column:
    return F.left(collapsed(text), F.lit(limit))


def key_form(text: Column) -> Column:
    """Trimmed lower case with hyphens and spaces as underscores; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), r"[- ]", "_"), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


FILL = "array<struct<text:string,start:int,end:int,hole:int>>"


def template_fills(template: Column, text: Column, token: str = "[MASK]") -> Column:
    """struct(status, fills, warnings): what stands in a text where its template has holes.

    The text has to begin with the template's beginning; from there on each part after a hole is taken where it first follows,
    so of repeated parts the leftmost counts, and nothing is tried again. A hole at the end of the template, or before another hole, takes
    the rest. fills are (text, start, end, hole from 0). warnings are `missing_mask_token`, `template_prefix_mismatch`,
    `template_suffix_mismatch` (these three without fills), `template_trailing_text_mismatch`, and `empty_fill_span` for each
    hole that holds nothing; status is ok without any. A null template or text gives null."""
    quoted = r"\Q" + token + r"\E"
    none = F.array().cast(FILL)
    cut = F.split(template, quoted, -1)

    def fitted(b: Column) -> Column:
        parts, size = b["parts"], F.length(b["text"])
        head = F.element_at(parts, 1)
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x, i: F.struct(x.alias("part"), i.cast("int").alias("hole")))
        zero = F.struct(F.length(head).alias("at"), none.alias("fills"), F.lit(False).alias("lost"))

        def step(state: Column, x: Column) -> Column:
            open_ = x["part"] == ""
            found = F.when(open_, size).otherwise(F.call_function("locate", x["part"], b["text"], state["at"] + 1) - 1)
            lost = state["lost"] | (found < 0)
            fill = F.struct(F.substring(b["text"], state["at"] + 1, F.greatest(found - state["at"], F.lit(0))).alias("text"), state["at"].alias("start"), found.alias("end"), x["hole"].alias("hole"))
            return F.struct(F.when(lost, state["at"]).otherwise(found + F.length(x["part"])).cast("int").alias("at"), F.when(lost, state["fills"]).otherwise(F.array_append(state["fills"], fill)).cast(FILL).alias("fills"), lost.alias("lost"))

        got = F.aggregate(rest, zero, step)
        return F.transform(F.array(got), lambda g: judged(b, head, size, g))[0]

    def judged(b: Column, head: Column, size: Column, g: Column) -> Column:
        no_hole, no_head = F.size(b["parts"]) < 2, ~F.startswith(b["text"], head)
        bad = F.when(no_hole, "missing_mask_token").when(no_head, "template_prefix_mismatch").when(g["lost"], "template_suffix_mismatch")
        trailing = F.when(g["at"] != size, F.array(F.lit("template_trailing_text_mismatch"))).otherwise(F.array().cast("array<string>"))
        empty = F.transform(F.filter(g["fills"], lambda f: f["text"] == ""), lambda f: F.lit("empty_fill_span"))
        warnings = F.when(bad.isNotNull(), F.array(bad)).otherwise(F.concat(trailing, empty))
        return F.struct(F.when(F.size(warnings) == 0, "ok").otherwise("warning").alias("status"), F.when(bad.isNotNull(), none).otherwise(g["fills"]).alias("fills"), warnings.alias("warnings"))

    # an array of one binds the parts and the text
    out = F.transform(F.array(F.struct(cut.alias("parts"), text.alias("text"))), fitted)[0]
    return F.when(template.isNotNull() & text.isNotNull(), out)


def recovered_fills(template: Column, text: Column, token: str = "[MASK]") -> Column:
    """As template_fills for a recovered text: one that doesn't fit its template in every way is a fragment, with status
    `failed_fragment_recovery`, no fills and the one warning `fragment_recovery`."""
    out = template_fills(template, text, token)
    fragment = F.struct(F.lit("failed_fragment_recovery").alias("status"), F.array().cast(FILL).alias("fills"), F.array(F.lit("fragment_recovery")).alias("warnings"))
    return F.transform(F.array(out), lambda o: F.when(o["status"] == "warning", fragment).otherwise(o))[0]
