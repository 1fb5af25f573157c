"""Tensor files, lines over splits, versions of a table."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources import readers, tensors, writers


def frame(spark, rows, kind="key string, vector array<float>"):
    return spark.createDataFrame(rows, kind)


def held(df):
    return sorted((r["key"], r["row"], tuple(r["vector"])) for r in df.collect())


@pytest.mark.parametrize("layout", ["members", "matrix", "npy"])
@pytest.mark.parametrize("part", [{}, {"rowsPerPartition": 7, "bytesPerPartition": 64, "bytesPerBatch": 32}])
def test_round_trip(spark, tmp_path, layout, part):
    rows = [(f"k{i}", [float(i), i / 4, -1.0]) for i in range(100)]
    path = f"{tmp_path}/t"
    tensors.write(frame(spark, rows).repartition(3), path, key="key", vector="vector", layout=layout, rowsPerFile=20)
    got = held(tensors.read(spark, path, **part))
    assert sorted(v for _, _, v in got) == sorted(tuple(v) for _, v in rows)
    if layout != "npy":  # an array of rows has no keys
        assert {k: v for k, _, v in got} == {k: tuple(v) for k, v in rows}
    assert held(tensors.read(spark, "file://" + path, **part)) == got


def test_files_of_numpy_itself(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12, dtype=np.int16).reshape(4, 3))
    np.save(tmp_path / "b.npy", np.array([1.5, 2.5]))
    np.savez_compressed(tmp_path / "c.npz", one=np.array([1.0, 2.0]), many=np.ones((2, 3, 2), np.float16))
    np.savez(tmp_path / "empty.npz")
    (tmp_path / "_left").mkdir()
    np.save(tmp_path / "_left" / "hidden.npy", np.zeros(2))
    got = [(r["file"].rsplit("/", 1)[1], r["key"], r["row"], r["vector"]) for r in tensors.read(spark, str(tmp_path), type="double").orderBy("file", "key", "row").collect()]
    assert got == [*[("a.npy", str(i), i, [3.0 * i, 3 * i + 1, 3 * i + 2]) for i in range(4)], ("b.npy", "0", 0, [1.5, 2.5]), ("c.npz", "many", 0, [1.0] * 6), ("c.npz", "many", 1, [1.0] * 6), ("c.npz", "one", 0, [1.0, 2.0])]
    assert tensors.read(spark, str(tmp_path / "b.npy")).count() == 1


def test_broken_files_are_errors_or_problems(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.ones((2, 2)))
    np.save(tmp_path / "short.npy", np.ones((4, 2)))
    whole = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-5])
    (tmp_path / "text.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "names.npz", names=np.array(["a", "b"]))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(Exception, match=r"columns.npy|names.npz|short.npy|text.npz"):
        tensors.read(spark, str(tmp_path)).count()
    rows = tensors.read(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sorted(r["file"].rsplit("/", 1)[1] for r in rows if r["problem"]) == ["columns.npy", "names.npz", "short.npy", "text.npz"]
    assert [r["vector"] for r in rows if not r["problem"]] == [[1.0, 1.0]] * 2
    with pytest.raises(Exception, match="not there"):
        tensors.read(spark, f"{tmp_path}/nothing").count()


def test_only_committed_files_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    tensors.write(frame(spark, [("a", [1.0]), ("b", [2.0])]), path, key="key", vector="vector")
    np.savez(f"{path}/part-00000-left-by-a-dead-task.npz", keys=np.array(["x"]), vectors=np.ones((1, 1)))
    assert [k for k, _, _ in held(tensors.read(spark, path))] == ["a", "b"]
    tensors.write(frame(spark, [("c", [3.0])]), path, key="key", vector="vector", mode="append")
    assert [k for k, _, _ in held(tensors.read(spark, path))] == ["a", "b", "c"]
    before = json.loads((tmp_path / "t" / "_manifest.json").read_text())
    for bad in ([("d", [1.0, 2.0])], [("d", None)], [(None, [1.0])], [("d", [1.0]), ("e", [1.0, 2.0])]):
        with pytest.raises(Exception, match="length|null|instead of"):
            tensors.write(frame(spark, bad).coalesce(1), path, key="key", vector="vector", mode="append")
        assert json.loads((tmp_path / "t" / "_manifest.json").read_text()) == before  # a failed write changes nothing
    tensors.write(frame(spark, [("z", [9.0, 9.0])]), path, key="key", vector="vector")
    assert held(tensors.read(spark, path)) == [("z", 0, (9.0, 9.0))]
    tensors.write(frame(spark, []), path, key="key", vector="vector")
    assert held(tensors.read(spark, path)) == []


def test_strict_and_tolerant_joins(spark):
    records = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    good = frame(spark, [("1", [1.0, 2.0]), ("2", [3.0, 4.0]), ("3", [5.0, 6.0]), ("9", [0.0, 0.0])], "id string, vector array<float>")
    assert [tuple(r) for r in tensors.strict_vectors(records, good, "id").orderBy("id").collect()] == [(1, "x", [1.0, 2.0]), (2, "y", [3.0, 4.0]), (3, "z", [5.0, 6.0])]
    for bad, fault in ((good.where("id <> '2'"), "2: missing"), (good.unionByName(good.where("id = '3'")), "3: doubled"), (good.where("id <> '1'").unionByName(frame(spark, [("1", [1.0])], "id string, vector array<float>")), "1: short")):
        with pytest.raises(tensors.TensorError, match=fault):
            tensors.strict_vectors(records, bad, "id")
    mixed = frame(spark, [("1", [1.0, float("nan")]), ("1", [1.0]), ("2", [1.0, 2.0]), (None, [1.0, 2.0])], "id string, vector array<float>")
    got = {r["id"]: (r["warnings"], r["vector"]) for r in tensors.tolerant_vectors(records, mixed, "id").collect()}
    assert got == {1: (["doubled", "not finite", "short"], None), 2: ([], [1.0, 2.0]), 3: (["missing"], None)}
    assert {tuple(r) for r in tensors.vector_faults(records, mixed, "id", width=3).collect()} >= {("2", "short"), ("3", "missing")}


def test_arm_admits_only_whole_tables(spark):
    rows = [(i, f"g{i // 2}", i % 2, i < 8, "main", float(i), 0.0) for i in range(10)]
    kind = "id long, grp string, y int, eligible boolean, population_role string, f1 double, s_x double"
    records, vectors = frame(spark, rows, kind), frame(spark, [(str(i), [float(i), 1.0]) for i in range(10)], "id string, vector array<float>")
    ask = {"key": "id", "group": "grp", "label": "y", "features": ["f1", "s_x"], "sparse": ("s_",)}
    assert tensors.arm(records, vectors, **ask).count() == 8
    assert tensors.arm(records, vectors.where("id < 8"), **ask).count() == 8  # those that take no part need no vector
    for df, match in (
        (records.withColumn("population_role", F.lit("pilot_smoke")), "pilot"), (records.withColumn("eligible", F.lit(False)), "eligible"), (records.withColumn("y", F.lit(1)), "classes"), (records.withColumn("f1", F.lit(None).cast("double")), "never vary: f1"),
        (records.withColumn("grp", F.when(F.col("id") != 3, F.col("grp"))), "without a group"),
    ):
        with pytest.raises(tensors.TensorError, match=match):
            tensors.arm(df, vectors, **ask)
    with pytest.raises(tensors.TensorError, match="5: missing"):
        tensors.arm(records, vectors.where("id <> 5"), **ask)


@pytest.mark.parametrize("split", [40, 64, 1000, 10**9])
def test_lines_are_numbered_over_splits(spark, tmp_path, split):
    files = {"a.jsonl": "".join(f'{{"v": {i}, "s": "é{"x" * (i % 37)}"}}\n' for i in range(300)), "b.jsonl": '{"v": 1}\r\n\r\n{"v": "no"}\r\nnothing\n[1]', "c.jsonl": ""}
    for name, content in files.items():
        (tmp_path / name).write_text(content, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = readers.numbered_lines(spark, f"{tmp_path}/*.jsonl")
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines.collect() if r["value"])
        assert got == [(n, i, v) for n, c in files.items() for i, v in enumerate(c.replace("\r\n", "\n").split("\n"), 1) if v]
        if split == 64:
            assert spark.read.text(f"{tmp_path}/a.jsonl").rdd.getNumPartitions() > 50
        bad = [(r["file"].rsplit("/", 1)[1], r["line"]) for r in readers.bad_lines(spark, f"{tmp_path}/*.jsonl", "v int").orderBy("file", "line").collect()]
        assert bad == [("b.jsonl", 3), ("b.jsonl", 4), ("b.jsonl", 5)]
        with pytest.raises(readers.SourceError, match=r"b.jsonl, line 3"):
            readers.jsonl_checked(spark, f"{tmp_path}/*.jsonl", "v int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_table_always_has_a_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError, match="no version"):
        writers.latest(spark, path)
    writers.replaced(spark.range(3), path)
    reader = writers.latest(spark, path)
    with pytest.raises(Exception):  # noqa: B017  a run that dies while it writes
        writers.replaced(spark.range(9).select(F.raise_error(F.lit("dies")).alias("id")), path)
    assert writers.latest(spark, path).count() == 3
    for n in (5, 7):
        writers.replaced(spark.range(n), path)
        assert writers.latest(spark, path).count() == n
        if n == 5:
            assert reader.count() == 3  # who still reads the version before may finish
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_splice_of_many_spans(spark):
    n = 4000
    text = "".join(f"w{i % 10}é " for i in range(n))
    df = spark.createDataFrame([(text, [(4 * i, 4 * i + 2) for i in range(n)]), ("abc", []), (None, [(0, 1)]), ("abc", [(0, 1), (2, 3)]), ("abc", [(1, 1)])], "t string, s array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(X.splice(F.col("t"), F.col("s"), lambda s: F.concat(F.lit("<"), s["start"].cast("string"), F.lit(">")))).collect()]
    assert got == ["".join(f"<{4 * i}>é " for i in range(n)), "abc", None, "<0>b<2>", "a<1>bc"]
    assert df.where("t = 'abc'").select(X.splice(F.col("t"), F.col("s"), lambda s: F.when(s["start"] > 5, "x"))).collect()[1][0] is None
