"""What grows with the input is neither broadcast nor copied over and over."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.llm import topk
from tessera.operators import formulas, probes, reports, spans
from tessera.plans import base, report_queries, rule_queries
from tessera.sources import audits
from tessera.streaming import work


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_broadcasts_no_copies_of_queries(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3, lanes=5)
    assert "SortMergeJoin" in plan(got) and "BroadcastExchange" not in plan(got)
    assert got.count() == 9


def test_recomputed_values_are_merged(spark):
    old = spark.createDataFrame([(i, float(i % 5), float(i)) for i in range(40)], "k long, a double, b double")
    new = old.where("k % 4 > 0").select("k", "a", F.when(F.col("k") % 5 == 0, -F.col("b")).otherwise(F.col("b")).alias("b"))
    got = reports.recomputed(old, new, ["k"], ["a", "b"])
    assert {r["feature"]: (r["rows"], r["same_rate"]) for r in got.collect()} == {"a": (30, 1.0), "b": (30, 0.8)}
    # old with new, and both ranks
    assert plan(got).count("SortMergeJoin") >= 3


def test_identifiers_of_any_length_are_named(spark):
    rows = [("Part T21000 x", "T21000", True), ("Part T1000 x", "T1000", True), ("CWE-100001, so", "CWE-100001", True), ("T1059.001 is", "T1059", False), ("T210001 is", "T21000", False), ("none", "T21000", False), (None, "T1000", None)]
    df = spark.createDataFrame(rows, "q string, i string, want boolean").withColumn("got", probes.asks_itself(F.col("q"), F.col("i")))
    assert [(r["q"], r["got"]) for r in df.collect()] == [(r[0], r[2]) for r in rows]


def test_fillers_bind_what_they_use_again(spark):
    made = X.tolerant_filler(F.lit("Tom has [MASK] apples today."), F.col("t"))
    df = spark.createDataFrame([("tom has: 3 big ones apples, today",), ("x",), ("Tom has  apples today.",), (None,)], "t string").select(made.alias("f"))
    assert [r["f"] for r in df.collect()] == ["3 big ones", "x", "", None]
    # the words of the text are cut out in one place
    assert plan(df).count(r"\S+") == 1


def test_imported_ids_have_the_places_of_the_sql(spark):
    got = report_queries.six_places(spark.range(999_998, 1_000_002).select(F.concat(F.lit("parts_train_"), F.format_string("%06d", "id")).alias("id")), "id")
    assert [r["id"] for r in got.orderBy("id").collect()] == ["parts_train_100000", "parts_train_100000", "parts_train_999998", "parts_train_999999"]


def test_units_sort_the_spans_once(spark):
    # once for the spans, once for the groups
    assert str(spans.units(F.col("spans"))).count("array_sort") == 2


def test_overlaps_are_thinned_in_lists_of_many_texts(spark):
    rows = [(k, s, e, t, x) for k in range(50) for s, e, t, x in [(0, 5, "number", "12345"), (0, 9, "number_unit", "12345 cat"), (6, 9, "object", "cat"), (6, 9, "object", "cat"), (20, 22, None, "of")]]
    got = spans.unoverlapped(spark.createDataFrame(rows, "k long, start int, end int, type string, text string"), "k")
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert sorted(map(tuple, got.where("k = 7").collect())) == [(7, 0, 5, "number", "12345"), (7, 0, 9, "number_unit", "12345 cat"), (7, 20, 22, None, "of")]
    assert got.count() == 150


@pytest.mark.parametrize("records", [0, 3])
def test_csv_rows_never_go_through_the_driver(spark, tmp_path, records):
    (tmp_path / "a.csv").write_text("id,question,answer\n" + "".join(f'{i % 2},"a ""b""\nc",{i},over\n' for i in range(records)))
    (tmp_path / "wide.csv").write_text(",".join(f"f{i}" for i in range(30)) + ",id\n" + ",".join("x" * 31) + "\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in audits._csv(spark, [str(tmp_path)]).collect()}
    assert [tuple(got["a.csv"][c] for c in ("records", "fields", "ids"))] == [(records, ["answer", "id", "question"], min(records, 2))]
    assert got["wide.csv"]["records"] == 1 and len(got["wide.csv"]["fields"]) == 31
    text = plan(audits._csv(spark, [str(tmp_path)]))
    assert "min_by" not in text and text.count("c40#") == 0


def test_spans_are_dealt_once_to_as_many_tasks_as_they_need(spark, sf, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 500)
    rows = base.spans(spark, sf)
    assert rows.count() > 2_000 and rows.rdd.getNumPartitions() > 4
    for got in (formulas.ranking_metrics(formulas.budget(rows)), formulas.coverage(rows)):
        # what is dealt by question is neither dealt by span before, nor again for ranks or sums
        assert plan(got).count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(question_id" not in plan(got) and "l_linenumber" not in "".join(x for x in plan(got).splitlines() if "Exchange" in x)


def test_wins_come_from_one_order_of_flags(spark):
    numbers = {formulas.ON: 3, formulas.OFF: 4, formulas.AMBIGUOUS: 2}
    data = [(q, f"{q}-{s}-{i}", "number", s, i % 4, {"A": float((i * 7 + q) % 3), "B": None if i == 1 else float(i)}) for q in range(4) for s, n in numbers.items() for i in range(n)]
    df = spark.createDataFrame(data, "question_id long, span_id string, span_type string, status string, bucket int, formula_scores map<string, double>")
    got = {r["formula"]: r for r in formulas.ranking_metrics(df).collect()}
    for f in "AB":
        score = [(q, s, b, m[f] or 0.0) for q, _, _, s, b, m in data]
        for column, high, low in (("pair_accuracy", lambda r: r[1] == formulas.ON, lambda r: r[1] == formulas.OFF), ("bucket_accuracy", lambda r: r[2] == 3, lambda r: r[2] == 1)):
            met = [(x[3] > y[3]) + (x[3] == y[3]) / 2 for x in score if high(x) for y in score if low(y) and x[0] == y[0]]
            assert got[f][column] == pytest.approx(sum(met) / len(met))
    assert got["A"]["pairs"] == 48
    # places and wins share a sort, and names aren't sorted with every formula
    sorts = [x for x in plan(formulas.ranking_metrics(df)).splitlines() if "Sort [" in x]
    assert len(sorts) == 2 and "span_id" not in "".join(x for x in sorts if "formula" in x)


def test_medians_of_a_question_make_no_lists(spark):
    data = [("a", i, x, y) for i, (x, y) in enumerate([(0.5, 0.1), (None, 0.9), (0.25, 0.3), (1.0, 0.2)])] + [("b", 9, None, 0.4)]
    df = spark.createDataFrame(data, "question_id string, span_id long, response double, attention double").withColumns({"surface": F.lit(0.0), "prompt": F.lit(0.0)})
    got = formulas.responses(df)
    gates = {r["span_id"]: (r["formula_scores"]["G_response_output_gate_then_attention"], r["formula_scores"]["H_attention_gate_then_response_output"]) for r in got.collect()}
    # of 0.25, 0.5, 1.0 the second, of 0.1, 0.2, 0.3, 0.9 the third
    assert gates == {0: (0.1, 0.01), 1: (pytest.approx(0.018), None), 2: (pytest.approx(0.006), 0.25), 3: (0.2, 0.02), 9: (pytest.approx(0.008), None)}
    assert "collect_list" not in plan(got)


def test_upper_median_orders_values_not_rows(spark):
    df = spark.createDataFrame([(x,) for x in [0.5, 0.1, 0.5, 0.9, 0.1, 0.5]], "x double")
    assert [r["median"] for r in formulas.upper_median(df, F.col("x")).collect()] == [0.5]
    assert formulas.upper_median(df.where("x > 0.6 or x < 0.2"), F.col("x")).first()["median"] == 0.1
    assert formulas.upper_median(df.where("x > 2"), F.col("x")).count() == 0


def test_numbers_are_read_once(spark, sf):
    written = ["$1,000", "50%", "5 percent", "twelve", "..Twelve.", "", None, "x", "0%", "-3.50"]
    df = spark.createDataFrame([(t,) for t in written], "t string")
    values = X.number_values(F.col("t"))
    assert [r["v"] for r in df.select(values.alias("v")).collect()] == [[1000.0], [50.0, 0.5], [5.0, 0.05], [12.0], [12.0], [], [], [], [0.0], [-3.5]]
    # the digits are cut out in one place
    assert plan(df.select(values.alias("v"))).count("regexp_extract(") == 1
    got = rule_queries.solution_path(spark, sf)
    assert plan(got).count("FileScan") == 1 and "Join" not in plan(got) and plan(got).count("Exchange hashpartitioning(") == 2


def test_numbers_of_one_id_count_together(spark, tmp_path):
    # two orders of one key, and the key of a literal row of the same group: a number that stands in several of their questions is ambiguous
    spark.createDataFrame([(101, 1), (101, 1), (101, 2), (7, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(rule_queries.SOLUTION_PATH).fetchall()
    assert sorted(map(tuple, rule_queries.solution_path(spark, str(tmp_path)).collect())) == sorted(want)


def test_states_of_work_deal_each_row_once(spark):
    unit = "unit_id string, fingerprint string"
    units = spark.createDataFrame([(u, "f") for u in ("done", "done", "lost", "failed", "stale", "new")] + [(None, "f"), ("bare", None)], unit)
    done = spark.createDataFrame([("done", "f"), ("done", "f"), ("stale", "old"), ("lost", "old"), (None, "f"), ("bare", None)], unit)
    events = spark.createDataFrame([("done", "f", "failed", 1), ("done", "f", "done", 2), ("lost", "f", "done", 1), ("failed", "f", "failed", 1), ("failed", "f", "failed", 2), ("new", "old", "failed", 3), (None, "f", "done", 4)], f"{unit}, status string, attempt int")
    got = work.states(units, events, done)
    assert plan(got).count("Exchange") == 1 and "Join" not in plan(got)
    want = {("done", "done", 2, 1), ("lost", "lost", 1, 0), ("failed", "failed", 2, 2), ("stale", "stale", 0, 0), ("new", "new", 0, 0), (None, "new", 0, 0), ("bare", "stale", 0, 0)}
    assert {(r["unit_id"], r["state"], r["attempts"], r["failures"]) for r in got.collect()} == want and got.count() == len(want)
