"""Event-time windows in batch form; the streaming forms in events.py share these definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables

R = Registry()


@R.operator("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total
FROM events GROUP BY ALL""")
def events_tumbling(t: Tables) -> DataFrame:
    return tumbling(t.events, "1 hour")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Counts and sums of each event type in windows of a width."""
    rows = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total")
    )
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@R.operator("""
SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, count(*) AS n
FROM events, (VALUES (0), (1)) s(k) GROUP BY ALL""")
def events_sliding(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@R.operator("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
