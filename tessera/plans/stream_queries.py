"""Queries over the event log, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import events as E
from .base import table

# The state that an event type stands for.
STATE = {"signup": "pending", "click": "running", "view": "running", "purchase": "done", "error": "failed"}


def _log(spark, d):
    e = table(spark, d, "events")
    state = F.create_map(*[F.lit(x) for kv in STATE.items() for x in kv])
    return e.select(F.col("user_id").alias("unit_id"), F.try_element_at(state, F.col("event_type")).alias("status"), F.col("event_id").alias("seq"))


LOG = "(SELECT user_id AS unit_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, event_id AS seq FROM events)"


def latest_status(spark, d):
    return E.current(_log(spark, d))


LATEST_STATUS = f"SELECT unit_id, arg_max(status, seq) AS status, max(seq) AS seq FROM {LOG} GROUP BY unit_id"


def pending_units(spark, d):
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"))
    return E.pending(units, _log(spark, d))


PENDING_UNITS = f"SELECT DISTINCT c_custkey AS unit_id FROM customer WHERE c_custkey NOT IN (SELECT unit_id FROM {LOG} GROUP BY unit_id HAVING arg_max(status, seq) = 'done')"


def unit_attempts(spark, d):
    return E.attempts(_log(spark, d))


UNIT_ATTEMPTS = f"SELECT unit_id, count(*) FILTER (status = 'running') AS attempts FROM {LOG} GROUP BY unit_id"


def status_counts(spark, d):
    return E.counts(_log(spark, d))


STATUS_COUNTS = f"SELECT status, count(*) AS units FROM (SELECT arg_max(status, seq) AS status FROM {LOG} GROUP BY unit_id) GROUP BY status"


def _stream(spark, d):
    return E.timed(spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").where("ts is not null"))


def tumbling_counts(spark, d):
    return E.tumbling(E.timed(table(spark, d, "events")), "1 day", ["event_type"]).select(F.col("start").cast("string").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


TUMBLING_COUNTS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


def sliding_counts(spark, d):
    return E.sliding(E.timed(table(spark, d, "events")), "2 days", "1 day", ["event_type"]).select(F.col("start").cast("string").alias("start"), "event_type", "events")


SLIDING_COUNTS = "SELECT strftime(date_trunc('day', ts) - to_days(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events FROM events, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS k) GROUP BY 1, 2"


def user_sessions(spark, d):
    return E.sessions(E.timed(table(spark, d, "events")), "30 minutes", ["user_id"]).select("user_id", F.col("start").cast("string").alias("start"), "events")


USER_SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, count(*) AS events FROM s GROUP BY user_id, s"


def latest_status_stream(spark, d):
    """The log replayed as a stream: the last update of each unit equals the batch result."""
    state = F.create_map(*[F.lit(x) for kv in STATE.items() for x in kv])
    log = _stream(spark, d).select(F.col("user_id").alias("unit_id"), F.try_element_at(state, F.col("event_type")).alias("status"), F.col("event_id").alias("seq"))
    out = E.drained(E.status_stream(log), f"s{uuid.uuid4().hex}", "update")
    return E.current(out)


LATEST_STATUS_STREAM = LATEST_STATUS


def tumbling_counts_stream(spark, d):
    """Window counts of the stream in complete mode, all windows."""
    out = E.drained(E.tumbling(_stream(spark, d), "1 day", ["event_type"]), f"t{uuid.uuid4().hex}", "complete")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


TUMBLING_COUNTS_STREAM = TUMBLING_COUNTS

QUERIES = {name: (globals()[name], globals().get(name.upper())) for name in (
    "latest_status", "pending_units", "unit_attempts", "status_counts", "tumbling_counts", "sliding_counts", "user_sessions", "latest_status_stream", "tumbling_counts_stream",
)}
