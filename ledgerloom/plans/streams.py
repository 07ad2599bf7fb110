"""Streaming operators run over a table as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.events import sessions, windowed_counts
from .registry import query


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value)::DECIMAL(38,10), 2)::DOUBLE AS mean FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean")


@query("""SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def stream_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
