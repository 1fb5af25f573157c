"""The stages of a study and data sets of questions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import contracts as K
from tessera.operators import datasets as D
from tessera.plans import pipelines as P

ROWS = [("q1", "d", " Tom has 3 apples and buys 2 more. How many apples does he have now? ", "5"), ("q2", "d", "Nothing to see", "0"), ("q3", "d", "如果有三个苹果，卖掉1个，还剩多少？", "2")]


def raw(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id string, dataset string, question string, gold_answer string")


@pytest.fixture(scope="module")
def study(spark):
    return {k: v.cache() for k, v in P.study(raw(spark)).items()}


def test_stages_agree(study):
    assert study["questions"].count() == 3
    n = {k: v.count() for k, v in study.items()}
    assert n["labelled"] == study["ablated"].where("status = 'kept'").count() and n["recovered"] == 3 * n["masked"]
    assert n["scores"] == n["masked"] == n["evidence"] == n["anchors"] == n["interventions"]
    assert {r["id"] for r in study["units"].select("id").distinct().collect()} == {"q1", "q3"}


def test_masked_and_scored(study):
    row = study["masked"].where("id = 'q1' and group_type = 'number_set'").collect()[0]
    assert row["masked_question"] == "Tom has [MASK] apples and buys [MASK] more. How many apples does he have now?"
    assert [s["kind"] for s in row["sources"]] == ["delete", "generalize"]
    scores = study["scores"].collect()
    assert {r["recoverability"] for r in scores} == {"Recoverable"} and {r["consistency"] for r in scores} == {1.0}
    anchor = study["anchors"].where("id = 'q1'").collect()[0]
    assert anchor["anchor_label"] == "Medium Anchor" and abs(anchor["importance"] - (0.6 * anchor["semantic_score"] + 0.1)) < 1e-9


def test_recovery_labels(spark):
    rows = spark.createDataFrame([("m", "q", "u", i, "a b", r) for i, r in enumerate(["a  b", "a c", ""])] + [("n", "q", "v", 0, "a", None)], "masked_id string, id string, unit_id string, sample_id int, question string, recovered_question string")
    got = {r["masked_id"]: r for r in P.recovery_scores(rows).collect()}
    assert (got["m"]["recoverability"], got["m"]["wrong"], got["m"]["misleading"]) == ("Partially Recoverable", 1, True)
    assert got["n"]["recoverability"] == "Non-recoverable"


def test_bad_questions(spark):
    with pytest.raises(K.ContractError):
        P.questions(raw(spark, [ROWS[0], ROWS[0]]))
    with pytest.raises(Exception, match="question filled"):
        P.questions(raw(spark, [("x", "d", " ", "")])).collect()


def test_multiple_choice(spark):
    rows = [(0, "Q?", {"b": "two", "A": "one", "c": "three"}, "B", None), (1, "Q?", {"A": "one"}, "A", "x"), (2, " ", {"A": "1", "B": "2"}, "A", None), (3, "R", {"A": "1", "B": "2"}, "Z", None), (4, "S", {"A": "1", "a": "2"}, "A", None), (5, "T", {"A": "1", "B": " "}, "A", None), (6, None, None, None, None)]
    got = {r["example_id"]: r for r in D.multiple_choice(spark.createDataFrame(rows, "original_index int, question string, answers map<string,string>, solution string, category string"), source="s").collect()}
    good = got["s_000000"]
    assert (good["gold_text"], good["gold_position"], good["problem"]) == ("two", 1, None)
    assert next(c["label_text"] for c in good["choices"] if c["choice"] == good["gold_label"]) == "two"
    assert [got[f"s_{i:06d}"]["problem"] for i in range(1, 7)] == ["fewer than two options", "no question", "no such solution", "duplicate option", "blank option", "no question"]
    again = D.multiple_choice(spark.createDataFrame(rows[:1], "original_index int, question string, answers map<string,string>, solution string, category string"), source="s").collect()[0]
    assert again == good
    mapping = D.letter_mapping(spark.createDataFrame([([("A", "x", 0), ("B", "y", 1)],), ([("A", "x", 0), ("C", "y", 1)],)], f"choices {D.CHOICES}"))
    assert {r["label_text"]: r["fixed"] for r in mapping.collect()} == {"x": True, "y": False}


def test_densities_and_labels(spark):
    o = spark.createDataFrame([("cve", "CVE-2020-0001"), ("cve", "CVE-2020-123456"), ("cve", "CVE-2021-0001"), ("cwe", "CWE-1")], "family string, normalized_id string")
    assert {r["family"]: (r["ids"], r["space"]) for r in D.id_density(o).collect()} == {"cve": (3, 2 * 996000), "cwe": (1, 99999)}
    assert {r["year"]: (r["ids"], r["largest"]) for r in D.year_density(o).collect()} == {"2020": (2, 123456), "2021": (1, 1)}
    c = spark.createDataFrame([(i,) for i in range(5)], "completion_id int")
    m = spark.createDataFrame([(0, "cwe", "fabricated"), (0, "cwe", "grounded"), (1, "attack", "grounded"), (2, "cwe", "echoed"), (3, "cve", "fabricated")], "completion_id int, family string, label string")
    assert {r["completion_id"]: (r["label"], r["excluded"]) for r in D.completion_labels(c, m).collect()} == {0: (1, None), 1: (0, None), 2: (None, "echoed_only"), 3: (None, "other_families_only"), 4: (None, "no_mention")}


def test_split_audit(spark):
    rows = spark.createDataFrame([("a", "g", "train"), ("a", "g", "test"), ("b", "h", "dev")], "example_id string, group_id string, split string")
    assert D.split_audit(rows).collect()[0].asDict() == {"records": 3, "duplicate_ids": 1, "groups": 2, "leaking_groups": 1}
