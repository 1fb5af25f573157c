"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.functions import lexicons as L
from tessera.plans import catalog

CATALOG = catalog()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda x: "" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_equals_sql(spark, sf, duck, name):
    query, sql = CATALOG[name]
    df = query(spark, sf)
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if not sql])
def test_runs(spark, sf, name):
    assert CATALOG[name][0](spark, sf).count() > 0


def spans_by_definition(text):
    found = {(m.start(), m.end(), "number", m[0]) for m in re.finditer(L.ARABIC_NUMBER, text)}
    found |= {(m.start(), m.end(), kind, m[0]) for kind, phrases in L.ENGLISH.items() for p in phrases for m in re.finditer(rf"(?i)(?<![A-Za-z0-9_]){re.escape(p)}(?![A-Za-z0-9_])", text)}
    stop = {p.lower() for k in ("question_target", "comparison", "negation", "condition", "operation") for p in L.ENGLISH[k]}
    found |= {(m.start(1), m.end(1), "object", m[1]) for m in re.finditer(L.NUMBER_NEIGHBOUR, text) if m[1].lower() not in stop}
    return sorted(sorted(found, key=lambda s: (L.SPAN_PRIORITY.index(s[2]) if s[2] in L.SPAN_PRIORITY else 100, *s[:2]))[:20])


def test_text_queries_read_whole_documents(spark, tmp_path):
    items = [(1, "How many of the 12 boxes are left if 3 boxes go?"), (2, "Not more than 5 files.")]
    docs = [(1, "The server dropped 40 requests, not 41. " * 3 + "filler words " * 400 + "WITHOUT a token, at least 7 users cannot log in."), (3, "plain text of no numbers"), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {("benchmark", i): t for i, t in items} | {("documents", i): t for i, t in docs}
    got = CATALOG["span_candidates"][0](spark, str(tmp_path)).where("origin <> 'question'").collect()
    want = {k: spans_by_definition(t) for k, t in texts.items()}
    assert {k: sorted((r["start"], r["end"], r["type"], r["text"]) for r in got if (r["origin"], r["item_id"]) == k) for k in texts} == want
    every = sum(map(len, want.values())) + CATALOG["span_candidates"][0](spark, str(tmp_path)).where("origin = 'question'").count()
    units = CATALOG["span_units"][0](spark, str(tmp_path)).collect()
    assert [r["units"] for r in units if r["unit_scope"] == "single"] == [every]
    assert sum(r["rows"] for r in CATALOG["ablation_status"][0](spark, str(tmp_path)).collect()) == 2 * sum(r["units"] for r in units)
    words = {k: re.findall(r"\b\w\w+\b", t.lower()) for k, t in texts.items()}
    tf = {k: Counter(w + [f"{a} {b}" for a, b in itertools.pairwise(w)]) for k, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    raw = {k: {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2} for k, c in tf.items()}
    weights = {(*k, t): w / math.sqrt(sum(x * x for x in c.values())) for k, c in raw.items() for t, w in c.items()}
    found = {(r["origin"], r["item_id"], r["term"]): r["weight"] for r in CATALOG["tfidf_terms"][0](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(weights, abs=1e-6) and any(k[0] == "documents" for k in found)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "spans", "docs", "starts", "chars"] and df.count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
