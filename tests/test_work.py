"""Resumable work that dies anywhere, and locks on tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import digests
from tessera.streaming import work

REQUEST = T.StructType().add("unit_id", "string").add("fingerprint", "string").add("payload", "long")
RESULT = T.StructType().add("unit_id", "string").add("fingerprint", "string").add("error", "string").add("value", "long")
STEPS = ["before work", "after work", "after outputs", "after log"]


class Killed(Exception):
    pass


def doubled(rows):
    return rows.select("unit_id", "fingerprint", F.when(F.col("payload") < 0, "negative").alias("error"), (F.col("payload") * 2).alias("value"))


def units(spark, rows):
    df = spark.createDataFrame(rows, "unit_id string, payload long")
    return df.select("unit_id", work.fingerprint(["unit_id", "payload"], {"factor": 2}).alias("fingerprint"), "payload")


def run(spark, root, **options):
    work.worked(spark, root, REQUEST, doubled, RESULT, **options)


def test_killed_anywhere_each_unit_stands_once(spark, tmp_path):
    for at in STEPS:
        root = f"{tmp_path}/{at.replace(' ', '-')}"
        asked = units(spark, [(f"u{i}", i) for i in range(6)])
        work.requested(asked, root)
        killed = []

        def step(name, at=at, killed=killed):
            if name == at and not killed:
                killed.append(name)
                raise Killed(name)

        with pytest.raises(Exception, match=at):
            run(spark, root, step=step)
        run(spark, root)
        run(spark, root)
        got = work.outputs(spark, root, RESULT)
        assert Counter(r["unit_id"] for r in got.collect()) == Counter({f"u{i}": 1 for i in range(6)})
        assert Counter((r["unit_id"], r["status"]) for r in work.log(spark, root).collect()) == Counter({(f"u{i}", "done"): 1 for i in range(6)})
        assert {r["state"] for r in work.states(asked, work.log(spark, root), got).collect()} == {"done"}


def test_stale_lost_failed_and_repeated(spark, tmp_path):
    root = str(tmp_path / "r")
    run(spark, root)  # nothing is asked for
    first = units(spark, [("a", 1), ("b", 2), ("c", -1)])
    work.requested(first, root)
    work.requested(first, root)
    run(spark, root, most_attempts=2)
    log = work.log(spark, root)
    assert sorted((r["unit_id"], r["status"], r["attempt"]) for r in log.collect()) == [("a", "done", 1), ("b", "done", 1), ("c", "failed", 1), ("c", "failed", 2)]
    run(spark, root, most_attempts=2)
    assert work.log(spark, root).count() == 4  # no attempt is left
    second = units(spark, [("a", 5), ("b", 2), ("d", 9)])  # other inputs of a
    states = {r["unit_id"]: r["state"] for r in work.states(second, work.log(spark, root), work.outputs(spark, root, RESULT)).collect()}
    assert states == {"a": "stale", "b": "done", "d": "new"}
    work.requested(second, root)
    run(spark, root, most_attempts=2)
    got = work.results(second, work.outputs(spark, root, RESULT))
    assert {r["unit_id"]: r["value"] for r in got.collect()} == {"a": 10, "b": 4, "d": 18}
    assert work.outputs(spark, root, RESULT).count() == 4  # b was not done again
    # outputs that are lost are asked for again, and a checkpoint that is lost does nothing twice
    import shutil

    shutil.rmtree(f"{root}/outputs")
    assert {r["state"] for r in work.states(second, work.log(spark, root), work.outputs(spark, root, RESULT)).collect()} == {"lost"}
    run(spark, root, most_attempts=2)
    assert {r["unit_id"]: r["value"] for r in work.results(second, work.outputs(spark, root, RESULT)).collect()} == {"a": 10, "b": 4, "d": 18}
    n = work.outputs(spark, root, RESULT).count()
    shutil.rmtree(f"{root}/checkpoint")
    run(spark, root, most_attempts=2)
    assert work.outputs(spark, root, RESULT).count() == n
    shutil.rmtree(f"{root}/log")
    assert {r["unit_id"] for r in work.healed(spark, root, RESULT).collect()} == {"a", "b", "d"}
    assert work.states(second, work.log(spark, root), work.outputs(spark, root, RESULT)).where("state = 'done'").count() == 3


def test_fingerprints_tell_values_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "b"), ("a", "null"), ("a|1:b", "")], "x string, y string")
    assert df.select(work.fingerprint(["x", "y"])).distinct().count() == 6
    assert df.limit(1).select(work.fingerprint(["x", "y"]) == work.fingerprint(["x", "y"], {"s": 1})).collect()[0][0] is False


def test_digests_see_rows_not_their_order(spark, tmp_path):
    rows = [(i, f"v{i % 5}" if i % 7 else None, i / 4, [i, 2]) for i in range(200)]
    kind = "id long, s string, x double, a array<int>"
    df = spark.createDataFrame(rows, kind)
    table = lambda d: sorted(map(tuple, digests.table_digest(d).collect()))
    base = table(df)
    assert [r[0] for r in base] == ["*", "a", "id", "s", "x"] and all(r[1] == 200 for r in base)
    assert table(df.repartition(7).orderBy(F.desc("id"))) == base
    lost, twice = df.where("id <> 3"), df.unionByName(df.where("id = 3"))
    changed = df.withColumn("s", F.when(F.col("id") == 3, "other").otherwise(F.col("s")))
    swapped = df.withColumn("x", F.when(F.col("id") == 3, 1.0).when(F.col("id") == 4, 0.75).otherwise(F.col("x")))
    pair = df.unionByName(df.where("id = 3")).unionByName(df.where("id = 3"))  # an exclusive or alone would miss it
    for other in (lost, twice, changed, swapped, pair):
        assert table(other) != base
    then = digests.table_digest(df)
    assert {tuple(r) for r in digests.differences(digests.table_digest(swapped), then).collect()} == {("*", "values")}  # the column holds the same values
    assert {tuple(r) for r in digests.differences(digests.table_digest(changed), then).collect()} == {("*", "values"), ("s", "values")}
    assert {r["what"] for r in digests.differences(digests.table_digest(lost), then).collect()} == {"rows"}
    assert all(r[1:] == (0, 0, 0, "0", 0) for r in table(df.where("id < 0")))

    path = f"{tmp_path}/lock"
    with pytest.raises(digests.LockError, match="no lock"):
        digests.unlocked(df, path)
    digests.lock(df, path)
    assert digests.unlocked(df.withColumn("new", F.lit(1)), path).count() == 200
    with pytest.raises(digests.LockError, match="s: values"):
        digests.unlocked(changed, path)
    with pytest.raises(digests.LockError, match="gone: x"):
        digests.unlocked(df.drop("x"), path)
