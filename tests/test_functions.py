"""String functions, rules and spans against Python on small texts."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import spans as S

TEXTS = ["", "a1b22", "12 and 3.5% of 1,200\n7", "é\U0001f600 9 日本 8", "no digits", "1"]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("pattern", [r"\d+", L.ARABIC_NUMBER, r"\s", "é"])
def test_matches(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.matches(F.col("t"), pattern).alias("m"))
    for r in df.collect():
        assert [tuple(m) for m in r["m"]] == [(m[0], m.start(), m.end()) for m in re.finditer(pattern, r["t"])]


def test_matches_of_null_and_group(spark):
    assert one(spark, X.matches(F.lit(None).cast("string"), r"\d")) is None
    got = one(spark, X.matches(F.lit("#### 12 x #### 3"), r"####\s*(\d+)", 1))
    assert [tuple(m) for m in got] == [("12", 5, 7), ("3", 15, 16)]


def test_occurrences_overlap(spark):
    assert [m["start"] for m in one(spark, X.occurrences(F.lit("aaaa"), "aa"))] == [0, 1, 2]
    assert one(spark, X.occurrences(F.lit(""), "aa")) == []


def test_candidates_of_the_example(spark):
    got = one(spark, S.candidates(F.lit("Tom has 3 apples and buys 2 more. How many apples does he have now?")))
    numbers = [(s["text"], s["start"], s["end"]) for s in got if s["type"] == "number"]
    assert numbers == [("3", 8, 9), ("2", 26, 27)]
    assert [s["span_id"] for s in got] == [f"span_{i:03d}" for i in range(1, len(got) + 1)]
    assert len(one(spark, S.candidates(F.lit("1 2 3 4 5 6"), most=4))) == 4


def test_units_and_ablation(spark):
    df = spark.createDataFrame([("If 2 users add 2 files and 3 files",)], "q string")
    units = S.with_units(df, "q").select("q", F.explode("units").alias("u"))
    kinds = {r[0] for r in units.select("u.group_type").collect()}
    assert {"single", "repeated_surface", "number_set", "object_set"} <= kinds
    rows = S.ablations(units.where("u.group_type = 'number_set'"), "q", "u").collect()
    assert {r["kind"]: r["ablated"] for r in rows} == {"delete": "If users add files and files", "generalize": "If some number users add some number files and some number files"}


def test_overlap_and_splice(spark):
    spans = F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 2, 'end', 4))")
    assert one(spark, X.overlapping(spans)) is True
    apart = F.expr("array(named_struct('start', 4, 'end', 6), named_struct('start', 0, 'end', 1))")
    assert one(spark, X.overlapping(apart)) is False
    assert one(spark, X.masked(F.lit("abcdefg"), apart, "_")) == "_bcd_g"


def test_clean_and_final(spark):
    assert one(spark, X.cleaned_recovery(F.lit("```text\nAnswer: Recovered question: How?\n```"))) == "How?"
    assert one(spark, X.final_part(F.lit("so #### 1,234"))) == "1234"
    assert one(spark, X.first_mask_filled(F.lit("a [MASK] b [MASK]"), "[MASK]", F.lit("x"))) == "a x b [MASK]"
    assert one(spark, X.filler(F.lit("a [MASK] b"), F.lit("a long word b"))) == "long word"
    assert one(spark, X.filler(F.lit("a [MASK] b"), F.lit("other"))) is None


def test_degeneration_rules(spark):
    def rules(text, **kw):
        return one(spark, X.degeneration(F.lit(text), F.lit(None).cast("string"), **kw))

    assert rules("!" * 30) == ["single_char_run", "substring_loop"] or rules("!" * 30) == ["single_char_run"]
    assert "substring_loop" in rules("x" + ".49221" * 5)
    assert rules("fine", tokens=F.lit(250)) == ["truncated_failure"]
    assert rules("fine") == []


def test_confidence_and_lists(spark):
    assert tuple(one(spark, X.stated_confidence(F.lit("It is probably, perhaps, so")))) == ("probably", 0, 1, 1)
    assert one(spark, X.list_like(F.lit("- a\n- b\n3. c\nCWE-79 d"))) is True
    assert one(spark, X.list_like(F.lit("- a\n- b"))) is False


def test_overlapped_tokens(spark):
    offsets = X.tokens(F.lit("one two, three"))
    assert one(spark, X.overlapped_tokens(offsets, F.lit(5), F.lit(8))) == [1, 2]


def test_choice_index_is_the_whole_digest(spark):
    import hashlib

    assert one(spark, X.choice_index(F.lit("q7"), 3, 11)) == int(hashlib.sha1(b"3:q7").hexdigest(), 16) % 11


def test_distributions(spark):
    p = V.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0)))
    assert one(spark, p) == [0.0, 0.0, 1.0]
    q = F.array(F.lit(0.5), F.lit(0.5))
    assert math.isclose(one(spark, V.entropy(q)), math.log(2))
    assert one(spark, V.kl(q, q)) == 0 and one(spark, V.js(q, F.array(F.lit(1.0), F.lit(0.0)))) > 0
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, V.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [3, 1, 2]
    assert one(spark, V.finite(F.lit(float("nan")))) is None and one(spark, V.finite(F.lit("2.5"))) == 2.5
    assert tuple(one(spark, V.logprob_summary(F.array(F.lit(-1.0), F.lit(float("nan")), F.lit(-3.0))))) == (2, -2.0, math.exp(2.0))
    assert one(spark, V.slope(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)))) == 2.0


def test_buckets_and_strength(spark):
    b = lambda kind, status, **k: one(spark, R.bucket(F.lit(kind), F.lit(status), *[F.lit(k.get(n, d)) for n, d in (("hard", False), ("majority", "exact_recovery"), ("generic", 0), ("unrecoverable", 0), ("exact", 4), ("samples", 4))]))
    assert b("number", "ambiguous_number") is None
    assert b("number", "off_solution_path_number", hard=True) == 0
    assert b("object", "not_a_number", hard=True) == 3
    assert b("object", "not_a_number", generic=2) == 2
    assert b("object", "not_a_number") == 1
    assert one(spark, R.risk_strength(F.lit(3), F.lit(0.5))) == 0.9


def test_anchor_and_recovery(spark):
    assert one(spark, R.anchor(F.lit(0.9), F.lit("Non-recoverable"), F.lit(False)))["label"] == "Strong Anchor"
    assert tuple(one(spark, R.recovery_sample(F.lit(0.8), F.lit(0.1)))) == ("Recoverable", 0.8, 0.8, False)
    assert one(spark, R.exact_recovery(F.lit(3), F.lit(0), F.lit(1))) == "Misleading Recovery"
    assert one(spark, R.margin(F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(0.5)), F.lit("a"))) == 1.5
