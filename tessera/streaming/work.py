"""Resumable work: each unit is done once for each state of its inputs, whatever dies in between.

A unit is asked for with a fingerprint of what it is made from. Requests arrive as files and are read as a stream; each batch
does the units that have no output of their fingerprint yet, writes their outputs to a folder named by stream and batch, and
only then puts events on the log, in a folder of the same name. A batch that is run again replaces both. Outputs decide what is done:
an event without an output is asked for again, an output without an event is put on the log.

Below a root: `requests` (unit_id, fingerprint, payload...), `outputs`, `log` (unit_id, fingerprint, status, attempt, error), and
`checkpoint`, the stream's own."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import drop_stored, stored

LOG = "unit_id string, fingerprint string, status string, attempt int, error string"


def fingerprint(columns: list[str | Column], settings: dict | None = None) -> Column:
    """SHA-256 of the columns and settings: another value, a null or another setting gives another one."""
    said = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("null")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.sha2(F.concat_ws("|", F.lit(json.dumps(settings or {}, sort_keys=True)), *said).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def log(spark: SparkSession, root: str) -> DataFrame:
    """All events, none if there is no log."""
    path = f"{root}/log"
    return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LOG)


def outputs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All outputs, of every fingerprint."""
    path = f"{root}/outputs"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def requested(units: DataFrame, root: str) -> None:
    """Ask for units: rows with unit_id, fingerprint and whatever the work needs. To ask twice is harmless."""
    units.write.mode("append").parquet(f"{root}/requests")


def states(units: DataFrame, events: DataFrame, done: DataFrame) -> DataFrame:
    """(unit_id, fingerprint, state, attempts, failures) of the units as they are now: `done` (an output of this fingerprint), `lost` (the log says done, but
    there is no output), `stale` (outputs of other fingerprints only), `failed`, or `new`."""
    unit = ["unit_id", "fingerprint"]
    no = F.lit(0)
    rows = lambda df, **flags: df.select(*unit, *[flags.get(n, no).cast("int").alias(n) for n in ("asked_", "has_", "other_", "said_", "failed_")], flags.get("attempt_", F.lit(None)).cast("int").alias("attempt_"))
    named = F.col("fingerprint").isNotNull()
    asked = rows(units, asked_=F.lit(1))
    has = rows(done.where("unit_id is not null"), has_=named, other_=F.lit(1))
    said = rows(events.where(F.col("unit_id").isNotNull() & named), said_=F.coalesce(F.col("status") == "done", F.lit(False)), failed_=F.coalesce(F.col("status") == "failed", F.lit(False)), attempt_=F.col("attempt"))
    # all three are dealt once by unit; null keys are asked for, and met by nothing
    met = asked.unionByName(has).unionByName(said).repartition("unit_id").groupBy(*unit).agg(*[F.max(n).alias(n) for n in ("asked_", "has_", "other_")], F.sum("said_").alias("said_"), F.sum("failed_").alias("failures"), F.coalesce(F.max("attempt_"), no).alias("attempts"))
    out = met.withColumn("other_", F.max("other_").over(Window.partitionBy("unit_id"))).where("asked_ = 1")
    state = F.when(F.col("has_") == 1, "done").when(F.col("said_") > 0, "lost").when(F.col("failures") > 0, "failed").when(F.col("other_") == 1, "stale").otherwise("new")
    return out.select(*unit, state.alias("state"), "attempts", "failures")


def results(units: DataFrame, done: DataFrame) -> DataFrame:
    """The outputs of the units as they are now, each once: those of other fingerprints and repeated ones are left out."""
    unit = ["unit_id", "fingerprint"]
    return done.join(units.select(*unit).dropDuplicates(unit), unit, "left_semi").dropDuplicates(unit)


def worked(spark: SparkSession, root: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], result: T.StructType, *, most_attempts: int = 3, step: Callable[[str], None] = lambda name: None) -> None:
    """Do what is asked for and not done. `schema` is that of requests; `work` maps requests to rows (unit_id, fingerprint, error, ...) of schema
    `result`, one for each unit: a row with an error failed and is asked for again, up to most_attempts times.

    May be killed anywhere and run again. `step` is called between steps, for tests."""

    def do(rows: DataFrame, name: str, without_output: bool = False) -> None:
        session = rows.sparkSession
        unit = ["unit_id", "fingerprint"]
        # what this very batch wrote before it died doesn't count: it is written again
        rest = lambda path, kind: session.read.schema(kind).option("recursiveFileLookup", True).parquet(path).where(~F.col("_metadata.file_path").contains(f"/{name}/"))
        todo, tried = rows.dropDuplicates(unit), None
        # what isn't there yet is not joined
        if not without_output and _exists(session, f"{root}/outputs"):
            todo = todo.join(rest(f"{root}/outputs", result).select(*unit), unit, "left_anti")
        if _exists(session, f"{root}/log"):
            tried = rest(f"{root}/log", T.StructType.fromDDL(LOG)).groupBy(*unit).agg(F.max("attempt").alias("before_"), F.count_if(F.col("status") == "failed").alias("failed_"))
            todo = todo.join(tried, unit, "left").where(F.coalesce("failed_", F.lit(0)) < most_attempts)
        step("before work")
        made = f"{root}/tried/{name}"
        work(todo.drop("before_", "failed_")).write.mode("overwrite").parquet(made)
        step("after work")
        rows_made = session.read.schema(result).parquet(made)
        rows_made.where("error is null").write.mode("overwrite").parquet(f"{root}/outputs/{name}")
        step("after outputs")
        said = rows_made.select(*unit, "error")
        said = said.withColumn("before_", F.lit(0)) if tried is None else said.join(tried, unit, "left")
        said.select(*unit, F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), (F.coalesce("before_", F.lit(0)) + 1).cast("int").alias("attempt"), "error").write.mode("overwrite").parquet(f"{root}/log/{name}")
        step("after log")

    if not _exists(spark, f"{root}/requests"):
        return
    stream = spark.readStream.schema(schema).parquet(f"{root}/requests")
    # a checkpoint that is made anew starts to count again, so batches are named by the checkpoint's own id
    place = f"{root}/checkpoint"
    name = _stream_name(spark, place)
    stream.writeStream.foreachBatch(lambda rows, number: do(rows, f"{name}-{number}")).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    _retry(spark, root, schema, result, most_attempts, do)


def _stream_name(spark: SparkSession, place: str) -> str:
    """A name that lives as long as the checkpoint beside it."""
    import uuid

    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{place}-name")
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(place)) or not fs.exists(file):
        out = fs.create(file, True)
        out.write(uuid.uuid4().hex.encode())
        out.close()
    stream = fs.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _retry(spark: SparkSession, root: str, schema: T.StructType, result: T.StructType, most_attempts: int, do: Callable[[DataFrame, str], None]) -> None:
    """Requests that the stream has passed and that have no output: failed ones, and those whose output was lost."""
    import uuid

    unit = ["unit_id", "fingerprint"]
    asked = spark.read.schema(schema).parquet(f"{root}/requests")
    for _ in range(most_attempts):
        failures = log(spark, root).where("status = 'failed'").groupBy(*unit).agg(F.count(F.lit(1)).alias("failures_"))
        open_ = asked.join(outputs(spark, root, result).select(*unit), unit, "left_anti").join(failures, unit, "left").where(F.coalesce("failures_", F.lit(0)) < most_attempts)
        # written, for it is asked whether there are any, and then they are done
        again = stored(open_.drop("failures_"), "again")
        if again.isEmpty():
            return
        do(again, f"again-{uuid.uuid4().hex}", without_output=True)
        drop_stored(again)


def healed(spark: SparkSession, root: str, result: T.StructType) -> DataFrame:
    """Events to put on the log for outputs that no event tells of."""
    unit = ["unit_id", "fingerprint"]
    told = log(spark, root).where("status = 'done'").select(*unit)
    attempt = F.row_number().over(Window.partitionBy(*unit).orderBy(F.lit(1)))
    missing = outputs(spark, root, result).select(*unit).dropDuplicates(unit).join(told, unit, "left_anti")
    return missing.select(*unit, F.lit("done").alias("status"), attempt.cast("int").alias("attempt"), F.lit(None).cast("string").alias("error"))
