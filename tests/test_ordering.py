"""Orders over a whole table of a million distinct values, over many ranges, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, datasets, ml, ordering, ranking, sampling, stats
from tessera.streaming import events

N = 1_000_000


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    """id, continuous score, label independent of it and a carried column, as Parquet over many files; and the same in numpy."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    path = str(tmp_path_factory.mktemp("scores") / "t")
    rng = F.xxhash64("id", F.lit(1))
    df = spark.range(N, numPartitions=16).select("id", (F.pmod(rng, F.lit(2**53)) / 2.0**53).alias("score"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0).cast("int").alias("label"), F.concat(F.lit("row "), "id").alias("carried"))
    df.write.parquet(path)
    df = spark.read.parquet(path)
    held = df.toPandas().sort_values("id").reset_index(drop=True)
    assert held["score"].nunique() == N
    yield df, held
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_row_numbers_have_no_gap(scores):
    df, held = scores
    got = ordering.global_row_number(df, [F.desc("score"), F.asc("id")], "n").select("id", "n", "carried").toPandas().sort_values("id")
    want = np.empty(N, np.int64)
    want[np.lexsort((held["id"], -held["score"]))] = np.arange(1, N + 1)
    assert (got["n"].to_numpy() == want).all() and len(got) == N
    # two readings of the same numbers agree with each other
    numbered = ordering.global_row_number(df, [F.asc("score")], "n")
    assert numbered.agg(F.count_distinct("n")).collect()[0][0] == N
    assert numbered.select("carried", "n").agg(F.max("n"), F.count_distinct("carried")).collect()[0][:] == (N, N)


def test_running_sums(scores):
    df, held = scores
    got = ordering.running_sums(df, [F.asc("score")], {"rows": F.lit(1), "hits": F.col("label")}).toPandas().sort_values("id")
    order = np.argsort(held["score"].to_numpy())
    want = np.empty(N, np.int64)
    want[order] = np.cumsum(held["label"].to_numpy()[order])
    assert (got["hits"].to_numpy() == want).all()
    want[order] = np.arange(1, N + 1)
    assert (got["rows"].to_numpy() == want).all()


def test_auroc_and_ranks(scores):
    df, held = scores
    rank = held["score"].rank().to_numpy()
    y = held["label"].to_numpy()
    p, q = y.sum(), (1 - y).sum()
    want = (rank[y == 1].sum() - p * (p + 1) / 2) / (p * q)
    r = stats.auroc(df, "score", "label").collect()[0]
    assert (r["positives"], r["negatives"]) == (p, q) and r["auroc"] == pytest.approx(want, abs=1e-12)
    got = stats.average_ranks(df, "score", "r").select("id", "r").toPandas().sort_values("id")
    assert (got["r"].to_numpy() == rank).all()
    other = df.withColumn("other", F.col("score") * 0.5 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2**53)) / 2.0**53)
    seen = other.select("other").toPandas()["other"]
    want = np.corrcoef(other.select("score").toPandas()["score"].rank(), seen.rank())[0, 1]
    assert stats.spearman(other, "score", "other").collect()[0]["spearman"] == pytest.approx(want, abs=1e-9)


def test_budget_precision_and_curves(scores):
    df, held = scores
    order = np.lexsort((held["id"], -held["score"]))
    y = held["label"].to_numpy()[order]
    r = ranking.budget(df, "score", "id", F.col("label") == 1, 0.2).collect()[0]
    assert (r["k"], r["hits"]) == (N // 5, y[: N // 5].sum())
    want = (np.cumsum(y) / np.arange(1, N + 1))[y == 1].mean()
    assert ranking.average_precision(df, "score", "id", "label").collect()[0]["auprc"] == pytest.approx(want, abs=1e-9)
    y = y[::-1]
    got = {r["coverage"]: (r["rows"], r["risk"]) for r in ranking.risk_coverage(df, "score", "id", F.col("label") == 1, [0.1, 0.5, 1.0]).collect()}
    assert got == {c: (int(N * c), pytest.approx(y[: int(N * c)].mean(), abs=1e-12)) for c in (0.1, 0.5, 1.0)}


def test_equal_parts_and_calibration(scores):
    df, held = scores
    got = {r["part"]: r["count"] for r in aggregates.equal_parts(df, "score", "id", 4).groupBy("part").count().collect()}
    assert got == {i: N // 4 for i in range(1, 5)}
    best = held.sort_values("score", ascending=False)["label"].to_numpy()[: N // 4].mean()
    assert aggregates.calibration(df, "score", "label", "id", 4).where("part = 1").collect()[0]["rate"] == pytest.approx(best, abs=1e-12)


def test_splits_folds_and_marks(scores):
    df, _ = scores
    got = {r["split"]: r["count"] for r in sampling.group_split(df, "id", {"train": 0.7, "dev": 0.15, "test": 0.15}).groupBy("split").count().collect()}
    assert got == {"train": 700_000, "dev": 150_000, "test": 150_000}
    assert {r["count"] for r in sampling.folds(df, "id", 5).groupBy("fold").count().collect()} == {N // 5}
    log = events.marked(df.withColumnRenamed("id", "unit_id"), "done", 7)
    assert log.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq"), F.count_distinct("unit_id")).collect()[0][:] == (7, N + 6, N, N)


def test_imports_lose_no_row(scores):
    df, _ = scores
    raw = df.select(F.col("carried").alias("question"), F.col("id").cast("string").alias("answer"))
    rows = datasets.imported(raw, ["question"], ["answer"], [sampling.order_of("question").asc()], dataset="d", split="train")
    assert rows.agg(F.count("id"), F.count_distinct("id"), F.count_distinct("original"), F.max(F.length("id"))).collect()[0][:] == (N, N, N, len("d_train_1000000"))


def test_isotonic_of_many_scores(scores):
    df, held = scores
    out = ml.isotonic_calibrated(df, "score", "label", train=F.lit(True)).select("id", "score", "calibrated", "carried").toPandas().sort_values("score")
    assert len(out) == N and out["calibrated"].is_monotonic_increasing
    assert out["calibrated"].mean() == pytest.approx(held["label"].mean(), abs=1e-9)


def test_small_and_empty(spark):
    df = spark.createDataFrame([("b", None), ("a", 2), ("c", 3)], "`a.b` string, v int")
    got = {r["a.b"]: (r["n"], r["s"]) for r in ordering.running_sums(ordering.global_row_number(df, [F.asc("`a.b`")], "n"), [F.asc("n")], {"s": F.col("v")}).collect()}
    assert got == {"a": (1, 2), "b": (2, 2), "c": (3, 5)}
    assert ordering.global_row_number(df.where("v > 9"), [F.asc("v")], "n").count() == 0
    assert ordering.running_sums(df.where("v > 9"), [F.asc("v")], {"s": F.col("v")}).count() == 0
