"""Queries that read their tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.plans.log_queries import LAST_SCHEMAS
from memlake.plans.registry import registry
from memlake.streaming.event_log import closed_sessions, drained, latest_snapshot, read_log, windowed

QUERIES, SQL, query = registry()


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def s1_closed_sessions(s, d):
    # one batch, so that no event is late, whatever the order of the files
    rows = drained(closed_sessions(read_log(s, f"{d}/events.parquet", None), "user_id", "ts"))
    return rows.select("user_id", F.unix_seconds("started").alias("started"), F.unix_seconds(F.col("ended") - F.expr("interval 12 hours")).alias("last"), "n")


@query(f"SELECT id, status, confidence, salience FROM {LAST_SCHEMAS}")
def s2_latest_snapshot(s, d):
    order = [F.desc("loaded_at"), F.desc("last_updated_ts"), F.desc("status"), F.desc("salience")]
    return latest_snapshot(read_log(s, f"{d}/memory_schemas.parquet"), ["id"], order).select("id", "status", "confidence", "salience")


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def s3_daily_windows(s, d):
    return drained(windowed(read_log(s, f"{d}/events.parquet"), "ts", "1 day", "event_type"), "complete").select(F.unix_seconds("start").alias("day"), "kind", "n")
