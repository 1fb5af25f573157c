"""Descriptors of files, tolerant Parquet, the index of ontologies."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from tessera.sources import audits
from tessera.sources.readers import SourceError


def test_every_file_is_described(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("questions.jsonl", '{"question": "q", "answer": 1}\n\n{"question": "r", "gold_answer": 2, "x": [1]}\n[1]\nbroken\n')
    put("deep/list.json", json.dumps([{"question": "a", "answer": "b"}, 7, {"id": "z"}]))
    put("object.json", '{"data": [1, 2]}')
    put("manifest_of_all.json", '{"question": 1}')
    put("scalar.json", "3")
    put("torn.json", '{"a": ')
    put("none.json", "[]")
    put("empty.jsonl", "\n")
    put("human_review.csv", 'id,question,answer\n1,"two\nlines",x\n2,"say ""hi""",y\n')
    put("rows.csv", "id,text\n1,a\n")
    put("units.jsonl", '{"id": "q1", "unit_id": 1}\n{"id": "q1", "unit_id": 2}\n{"id": "q2", "unit_id": 3}\n')
    put("other.txt", "no data file")
    put("broken.parquet", "this is no parquet")
    pq.write_table(pa.table({"question": ["a", "b"], "gold_answer": ["1", "2"]}), tmp_path / "good.parquet")
    got = {r["path"].rsplit("/", 1)[1]: r for r in audits.described(spark, [str(tmp_path)]).collect()}
    assert {n: (r["records"], r["source_type"], r["usable"]) for n, r in got.items()} == {
        "questions.jsonl": (4, "raw_question_source", True), "list.json": (3, "raw_question_source", True), "object.json": (1, "other", False), "manifest_of_all.json": (1, "report_or_manifest", False), "scalar.json": (0, "unreadable", False),
        "torn.json": (0, "unreadable", False), "none.json": (0, "empty", False), "empty.jsonl": (0, "empty", False), "human_review.csv": (2, "human_review_labels", False), "rows.csv": (1, "other", False), "units.jsonl": (3, "derived_downstream", False),
        "broken.parquet": (0, "unreadable", False), "good.parquet": (2, "raw_question_source", True),
    }
    assert got["questions.jsonl"]["fields"] == ["answer", "gold_answer", "question", "x"] and got["questions.jsonl"]["read_error"] == "1 undecodable lines"
    assert got["human_review.csv"]["fields"] == ["answer", "id", "question"] and got["units.jsonl"]["distinct_ids"] == 2 and got["rows.csv"]["distinct_ids"] is None
    assert got["good.parquet"]["reason"] is None and got["broken.parquet"]["read_error"] and got["torn.json"]["read_error"] == "undecodable document"
    assert audits.described(spark, [str(tmp_path / "deep")]).count() == 1


def test_a_torn_file_among_good_ones(spark, tmp_path):
    kind = T.StructType().add("id", "long").add("name", "string").add("more", "double")
    whole = pa.table({"id": list(range(100)), "name": [f"n{i}" for i in range(100)], "more": [i / 2 for i in range(100)]})
    for i in range(3):
        pq.write_table(whole, tmp_path / f"good{i}.parquet", row_group_size=40)
    data = bytearray((tmp_path / "good2.parquet").read_bytes())
    (tmp_path / "cut.parquet").write_bytes(data[:-20])
    start = pq.ParquetFile(tmp_path / "good2.parquet").metadata.row_group(1).column(1)
    at = start.dictionary_page_offset or start.data_page_offset
    data[at : at + 40] = b"\xff" * 40
    (tmp_path / "good2.parquet").write_bytes(data)
    pq.write_table(pa.table({"id": ["7", "x", "9"], "name": ["a", "b", "c"]}), tmp_path / "cells.parquet")
    rows, faults = audits.tolerant_parquet(spark, str(tmp_path), kind)
    found = rows.collect()
    assert len(found) == 100 + 100 + 60 + 3  # one group of 40 is lost
    cells = sorted((r["name"], r["id"], r["more"]) for r in found if r["name"] in ("a", "b", "c"))
    assert cells == [("a", 7, None), ("b", None, None), ("c", 9, None)]
    told = {(r["file"].rsplit("/", 1)[1], r["row_group"]): r["fault"] for r in faults.collect()}
    assert set(told) == {("cut.parquet", -1), ("good2.parquet", 1), ("cells.parquet", 0)} and told["cells.parquet", 0] == "1 values of id are no int64"


def entry(family, i, **more):
    return json.dumps({"family": family, "normalized_id": i, **more})


def test_ontology_of_three_families(spark, tmp_path):
    root = str(tmp_path)
    texts = {"cve": [entry("cve", "CVE-1", status="REJECTED"), "", entry("cve", "CVE-2"), entry("cve", "CVE-1", status="PUBLISHED", name="n")], "cwe": [entry("cwe", "CWE-79", status="deprecated")], "attack": [entry("attack", "T1", metadata={"x": 1})]}
    with pytest.raises(SourceError, match="no index of attack"):
        audits.ontology(spark, root)
    for family, lines in texts.items():
        (tmp_path / family).mkdir()
        (tmp_path / family / "ontology_index.jsonl").write_text("\n".join(lines) + "\n")
    entries, prints = audits.ontology(spark, root)
    assert {(r["family"], r["normalized_id"]): (r["status"], r["name"]) for r in entries.collect()} == {("cve", "CVE-1"): ("PUBLISHED", "n"), ("cve", "CVE-2"): ("unknown", None), ("cwe", "CWE-79"): ("deprecated", None), ("attack", "T1"): ("unknown", None)}
    assert {r["family"]: r["sha256"] for r in prints.collect()} == {f: hashlib.sha256(("\n".join(x) + "\n").encode()).hexdigest() for f, x in texts.items()}
    mentions = spark.createDataFrame([("cve", "CVE-1"), ("cve", "CWE-79"), ("cwe", None)], "fam string, id string")
    assert [(r["exists"], r["ontology_status"]) for r in audits.with_status(mentions, "fam", "id", entries).orderBy("fam", "id").collect()] == [(True, "PUBLISHED"), (False, None), (False, None)]
    for bad in (entry("cwe", "CVE-9"), "[1]", '{"family": "cve"}'):
        (tmp_path / "cve" / "ontology_index.jsonl").write_text(entry("cve", "CVE-1") + "\n" + bad + "\n")
        with pytest.raises(SourceError, match="line 2"):
            audits.ontology(spark, root)
