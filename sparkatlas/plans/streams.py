"""Queries that run as streams over the event log until all of it is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkatlas.operators.storage import shared_root
from sparkatlas.plans import adapters as A
from sparkatlas.plans.registry import query
from sparkatlas.streaming import logs


def _finished(spark, stream, schema: str):
    base = f"{shared_root(spark)}/sparkatlas/stream-{uuid.uuid4().hex}"
    logs.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(schema).parquet(f"{base}/out")


#: Events in microseconds, and the watermark at the end of the log.
CLOSED_SQL = """e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
mark AS (SELECT (max(us) // 1000) * 1000 - 600000000 AS us FROM e)"""


@query(
    "stream_sessions",
    f"""WITH {CLOSED_SQL},
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) >= 1800000000 THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, round(min(us) / 1e6, 3) AS first_at, round(max(us) / 1e6 + 1800, 3) AS end_at, count(*) AS n, round(sum(value), 6) AS total
FROM s GROUP BY user_id, sid HAVING max(us) + 1800000000 <= (SELECT us FROM mark)""",
)
def stream_sessions(spark, d):
    """Closed sessions with a gap of 30 minutes; the last ones stay open until later events come."""
    stream = logs.events_stream(spark, f"{d}/events.parquet*")
    found = _finished(spark, logs.sessions(stream, 30), "user_id long, start timestamp, end timestamp, n long, total double")
    at = lambda name: F.round(F.unix_micros(name) / 1e6, 3)
    return found.select("user_id", at("start").alias("first_at"), at("end").alias("end_at"), "n", F.round("total", 6).alias("total"))


@query(
    "stream_ttl_dedupe",
    f"""WITH RECURSIVE {CLOSED_SQL},
first AS (SELECT user_id, event_type, us, min(event_id) AS event_id FROM e GROUP BY ALL),
step AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us) AS place,
         min(us) OVER (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN 180000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM first),
passed AS (SELECT event_id, user_id, event_type, later FROM step WHERE place = 1
           UNION ALL SELECT s.event_id, s.user_id, s.event_type, s.later FROM passed p JOIN step s ON s.user_id = p.user_id AND s.event_type = p.event_type AND s.us = p.later)
SELECT event_id, user_id, event_type FROM passed""",
)
def stream_ttl_dedupe(spark, d):
    """Events that do not repeat a user's kind of event within 180 seconds of the last that passed."""
    stream = logs.events_stream(spark, f"{d}/events.parquet*", lateness="180 seconds")
    return _finished(spark, logs.dedupe_ttl(stream, ["user_id", "event_type"], ["event_id", "user_id", "event_type"]), "event_id long, user_id long, event_type string")


@query(
    "stream_hourly",
    f"""WITH {CLOSED_SQL}
SELECT (us // 3600000000) * 3600 AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e
WHERE (us // 3600000000 + 1) * 3600000000 <= (SELECT us FROM mark) GROUP BY 1, 2""",
)
def stream_hourly(spark, d):
    """Closed hours; the last one stays open until later events come."""
    stream = logs.events_stream(spark, f"{d}/events.parquet*")
    found = _finished(spark, logs.tumbling(stream), "start timestamp, event_type string, n long, total double")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "fixed_gap_sessions",
    f"""WITH {A.LOG_SQL}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) >= 1800 THEN 1 ELSE 0 END AS new FROM log),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, round(min(sec), 3) AS first_at, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def fixed_gap_sessions(spark, d):
    """The batch form of stream_sessions, open ones too."""
    w = F.session_window("ts", "30 minutes")
    return A.log(spark, d).groupBy("user_id", w).agg(F.round(F.min("sec"), 3).alias("first_at"), F.count("*").alias("n")).select("user_id", "first_at", "n")
