"""Queries over events: sessions, windows, buckets, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state
from .catalogue import query, table


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS events, CAST(sum(n) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    held = state.sessions(table(spark, sf, "events"), "user_id", "ts")
    return held.groupBy("user_id").agg(F.count("*").alias("events"), F.max("session").alias("sessions"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    return state.windowed(table(spark, sf, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("""WITH x AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS begins, event_type, value FROM events)
SELECT begins, event_type, count(*) AS events, round(sum(value), 6) AS total FROM x GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return state.windowed(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour", "30 minutes").withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 1 HOUR AS ends, count(*) AS events, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return state.session_totals(table(spark, sf, "events"), "user_id", "ts", "value").withColumn("total", F.round("total", 6))


_EACH = "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(
    _EACH
    + """, f AS (SELECT user_id, i, t, CAST(2.0 AS DOUBLE) - 1 AS tokens, 1 AS allowed, 0 AS denied FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, e.t, CASE WHEN least(2.0, tokens + (e.t - f.t) / 1e6 * 0.001) >= 1 THEN least(2.0, tokens + (e.t - f.t) / 1e6 * 0.001) - 1 ELSE least(2.0, tokens + (e.t - f.t) / 1e6 * 0.001) END,
  allowed + CAST(least(2.0, tokens + (e.t - f.t) / 1e6 * 0.001) >= 1 AS INT), denied + CAST(least(2.0, tokens + (e.t - f.t) / 1e6 * 0.001) < 1 AS INT) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, CAST(max(allowed) AS BIGINT) AS allowed, CAST(max(denied) AS BIGINT) AS denied FROM f GROUP BY user_id"""
)
def rate_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What a bucket of 2 tokens, filled every 1,000 s, lets each user do (a stateful fold)."""
    return state.token_bucket(table(spark, sf, "events"), "user_id", "ts", ["event_id"], rate=0.001, burst=2.0)


@query(
    _EACH
    + """, f AS (SELECT user_id, i, t AS fill, 0 AS hits FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - fill < 21600000000 THEN fill ELSE e.t END, hits + CAST(e.t - fill < 21600000000 AS INT) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, count(*) AS requests, CAST(max(hits) AS BIGINT) AS hits FROM f GROUP BY user_id"""
)
def cache_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return state.cache_hits(table(spark, sf, "events"), "user_id", "ts", 6 * 3600)


@query("SELECT user_id, max(ts) AS used FROM events GROUP BY 1 ORDER BY used DESC, user_id LIMIT 50")
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 users seen last: what a store of that size keeps."""
    states = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("used"))
    return state.keep_recent(states, "user_id", "used", 50)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_access(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
