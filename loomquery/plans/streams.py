"""Event-time queries: batch windows with an oracle, and the same operators run as streams over the files there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.plans.registry import register
from loomquery.session import table
from loomquery.streaming import events as S


@register("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@register("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """The same counts from a stream, in complete mode."""
    return S.run_to_table(S.tumbling(S.stream(spark, sf, "events.parquet")), "complete", "stream-windows")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), x AS (SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM x"""


@register("session_windows", _SESSIONS)
def session_windows(spark, sf):
    """Sessions of a user with gaps of at most six hours, over the whole table."""
    return S.sessions(table(spark, sf, "events"))


@register("stream_sessions", _SESSIONS + " WHERE x.end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_sessions(spark, sf):
    """The same from a stream in append mode: a session comes out once the watermark, a day behind the newest event, has
    passed its end."""
    return S.run_to_table(S.sessions(S.stream(spark, sf, "events.parquet")), "append", "stream-sessions")


@register("stream_job_state", "SELECT user_id, count(*) AS n_events, sum((event_type = 'error')::INT)::BIGINT AS errors, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def stream_job_state(spark, sf):
    """Job state folded over a stream with keyed state."""
    return S.run_to_table(S.fold_jobs(S.stream(spark, sf, "events.parquet")), "update", "stream-jobs", ["user_id"])


@register("stream_discovery", "SELECT o_orderkey, a.artifact, a.priority FROM orders, (VALUES ('THUMBNAIL', 0), ('PREVIEW', 1), ('HASHES', 2)) a(artifact, priority) WHERE o_orderkey % 3 <> 0")
def stream_discovery(spark, sf):
    """Files that a stream finds and the archive does not know become jobs."""
    known = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey")
    return S.run_to_table(S.discover(S.stream(spark, sf, "orders.parquet"), known, "o_orderkey", ["THUMBNAIL", "PREVIEW", "HASHES"]), "append", "stream-discovery")
