"""An append-only log of work events: current state, what is pending, resumable runs, in batch and as a stream.

An event is (unit_id, status, seq): status is pending, running, done or failed; seq is its place in the log."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a unit.
STATUSES = ["pending", "running", "done", "failed"]


def replay(lines: DataFrame, *, value: str = "value", seq: str = "seq") -> DataFrame:
    """Events of a log of JSON lines in order: reading stops at the first torn line; lines without a unit or with an
    unknown status are passed over."""
    parsed = lines.select(F.col(seq).alias("seq"), F.trim(value).alias("v")).where("v <> ''").withColumn("e", F.from_json("v", "unit_id string, status string, attempt int, error string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    torn = parsed.agg(F.min(F.when(F.col("e").isNull() | F.col("e._corrupt_record").isNotNull(), F.col("seq"))).alias("torn"))
    rows = parsed.join(F.broadcast(torn)).where("torn is null or seq < torn")
    return rows.select("seq", "e.unit_id", "e.status", "e.attempt", "e.error").where(F.col("unit_id").isNotNull() & F.col("status").isin(STATUSES))


def current(events: DataFrame, key: str = "unit_id", status: str = "status", order: str = "seq") -> DataFrame:
    """The latest status of each unit. A partial aggregate, so a hot unit costs nothing more."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.max(order).alias(order))


def attempts(events: DataFrame, key: str = "unit_id", status: str = "status") -> DataFrame:
    return events.groupBy(key).agg(F.count_if(F.col(status) == "running").alias("attempts"))


def counts(events: DataFrame, key: str = "unit_id", status: str = "status", order: str = "seq") -> DataFrame:
    return current(events, key, status, order).groupBy(status).agg(F.count(F.lit(1)).alias("units"))


def complete(events: DataFrame) -> DataFrame:
    return current(events).agg(F.coalesce(F.bool_and(F.col("status") == "done"), F.lit(False)).alias("complete"))


def pending(units: DataFrame, events: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units that are not done: new, pending, running and failed ones."""
    done = current(events, key).where("status = 'done'").select(key)
    return units.select(key).distinct().join(done, key, "left_anti")


def registered(units: DataFrame, events: DataFrame, key: str = "unit_id") -> DataFrame:
    """Events that put unseen units on the log as pending."""
    return units.select(key).distinct().join(events.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("pending"))


def marked(units: DataFrame, status: str, at: int, key: str = "unit_id") -> DataFrame:
    """Events that put units in a state, with places in the log from `at` on; an unknown state is an error. To be appended to the log."""
    if status not in STATUSES:
        raise ValueError(f"{status!r} is none of {', '.join(STATUSES)}")
    from ..operators.ordering import global_row_number

    numbered = global_row_number(units.select(key).distinct(), [F.asc(key)], "r_")
    return numbered.select(key, F.lit(status).alias("status"), (F.col("r_") - 1 + at).cast("long").alias("seq"))


def resumed(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Apply work to the rows whose key the table at `path` lacks, and append. Returns how many were left.

    A run that died half-way leaves only committed files, so running again picks up the rest."""
    spark = todo.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
    left = todo.count()
    if left:
        work(todo).write.mode("append").parquet(path)
    return left


# ---- as a stream


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, size: str, by: list[str], *, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Counts and sums of `value` by window and keys, closed once the watermark has passed. Batch tables work too."""
    w = F.window(column, size)
    out = events.withWatermark(column, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "events", "value")


def sliding(events: DataFrame, size: str, step: str, by: list[str], *, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    out = events.withWatermark(column, late).groupBy(F.window(column, size, step), *by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "events")


def sessions(events: DataFrame, gap: str, by: list[str], *, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    out = events.withWatermark(column, late).groupBy(F.session_window(column, gap), *by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "events")


def status_stream(events: DataFrame, key: str = "unit_id", status: str = "status", order: str = "seq") -> DataFrame:
    """Latest status of each unit as events arrive (update mode), by keyed state of one row; older events change nothing."""

    def step(k: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, value = state.get if state.exists else (-(1 << 62), None)
        for b in batches:
            i = b[order].astype("int64").idxmax()
            if b[order][i] > best:
                best, value = int(b[order][i]), b[status][i]
        state.update((best, value))
        yield pd.DataFrame({key: [k[0]], status: [value], order: [best]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {status} string, {order} long", f"{order} long, {status} string", "update", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it put out: all batches, or the last one in complete mode.

    Batches are written to a folder each below the shared folder, with the stream's checkpoint beside them, so nothing is gathered
    on the driver, and a batch that is run again replaces itself. Names are for one use each."""
    from ..sources.storage import shared_dir

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tessera/drained-{name}"
    numbers: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    read = f"{path}/batch={max(numbers)}" if mode == "complete" else f"{path}/batch=*"
    return spark.read.schema(stream.schema).parquet(read)


def written_once(stream: DataFrame, path: str, checkpoint: str, *, key: Column | None = None) -> None:
    """Write a stream so that a batch that is run again replaces itself: each goes to a folder named by its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
