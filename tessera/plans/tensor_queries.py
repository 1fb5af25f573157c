"""Queries that write vectors to tensor files, read them back and join them with their records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tensors
from ..sources.storage import shared_dir
from .base import table


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def _digest(vector: str) -> list:
    """A whole number that depends on every component and its place, and the length."""
    weighed = F.transform(vector, lambda x, i: F.floor(x.cast("double") * 1000) * (i + 1))
    return [F.size(vector).alias("width"), F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x).alias("digest")]


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as archives of keys and vectors, read back and joined strictly with their records."""
    rows = table(spark, sf_dir, "embeddings")
    path = _folder(spark, "vectors")
    tensors.write(rows, path, key="vec_id", vector="embedding", rowsPerFile=500)
    return tensors.strict_vectors(rows.select("vec_id", "label"), tensors.read(spark, path), "vec_id").select("vec_id", "label", *_digest("vector"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as archives of one array a key, read by groups of members, summed by label."""
    rows = table(spark, sf_dir, "embeddings")
    path = _folder(spark, "members")
    tensors.write(rows, path, key="vec_id", vector="embedding", layout="members", rowsPerFile=300)
    back = tensors.read(spark, path, bytesPerPartition=20_000)
    met = tensors.strict_vectors(rows.select("vec_id", "label"), back, "vec_id").select("label", *_digest("vector"))
    return met.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.sum("digest").alias("digest"))


def by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of rows read by byte ranges of a hundred rows: what comes back, whatever the ranges."""
    rows = table(spark, sf_dir, "embeddings")
    path = _folder(spark, "arrays")
    tensors.write(rows, path, key="vec_id", vector="embedding", layout="npy")
    back = tensors.read(spark, path, rowsPerPartition=100).select("file", "row", *_digest("vector"))
    return back.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("file", "row").alias("places"), F.sum("digest").alias("digest"), F.max("width").alias("width"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are missing, doubled, short or not finite, found when they meet their records."""
    rows = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    broken = F.when(i % 11 == 2, F.slice("embedding", 1, 60)).when(i % 13 == 3, F.transform("embedding", lambda x, j: F.when(j == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding"))
    made = rows.where(i % 7 != 1).select("vec_id", broken.alias("embedding"))
    path = _folder(spark, "faulty")
    tensors.write(made.unionByName(made.where(i % 5 == 4)), path, key="vec_id", vector="embedding", layout="members", ragged="true")
    found = tensors.tolerant_vectors(rows.select("vec_id", "label"), tensors.read(spark, path), "vec_id")
    return found.select("vec_id", F.array_join("warnings", ", ").alias("warnings"), F.col("vector").isNotNull().alias("has_vector"))


_DIGEST = "CAST(list_sum(list_transform(embedding, lambda x, i: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) * i)) AS BIGINT)"

QUERIES = {
    "tensor_round_trip": (round_trip, f"SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width, {_DIGEST} AS digest FROM embeddings"),
    "tensor_members": (members, f"SELECT label, count(*) AS vectors, CAST(sum({_DIGEST}) AS BIGINT) AS digest FROM embeddings GROUP BY label"),
    "tensor_by_offset": (by_offset, f"SELECT count(*) AS vectors, count(*) AS places, CAST(sum({_DIGEST}) AS BIGINT) AS digest, CAST(max(len(embedding)) AS INTEGER) AS width FROM embeddings"),
    "tensor_faults": (
        faults,
        """
WITH f AS (
  SELECT vec_id, list_filter([
    CASE WHEN vec_id % 7 <> 1 AND vec_id % 5 = 4 THEN 'doubled' END, CASE WHEN vec_id % 7 = 1 THEN 'missing' END,
    CASE WHEN vec_id % 7 <> 1 AND vec_id % 11 <> 2 AND vec_id % 13 = 3 THEN 'not finite' END, CASE WHEN vec_id % 7 <> 1 AND vec_id % 11 = 2 THEN 'short' END
  ], lambda x: x IS NOT NULL) AS w
  FROM embeddings
)
SELECT vec_id, coalesce(array_to_string(w, ', '), '') AS warnings, len(w) = 0 AS has_vector FROM f
""",
    ),
}
