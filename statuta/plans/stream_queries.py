"""Event-time queries in batch form; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.plans.registry import query
from statuta.runtime import table
from statuta.streaming import traces


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS start_s, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000000 AS end_s, count(*) AS n, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'completed' END AS status FROM s GROUP BY user_id, k""")
def agg24_trace_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = traces.session_status(e)
    return s.select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n", "status")


@query("SELECT epoch_ms(date_trunc('hour', ts)) // 1000 AS hour_s, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def str_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return traces.hourly_counts(e).select(F.unix_seconds("hour").alias("hour_s"), "event_type", "n", "mean")
