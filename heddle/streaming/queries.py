"""Streaming queries over the events table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import drain, read_folder, sessions, windowed


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return read_folder(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(_events(spark, sf_dir), "ts", "1 hour", "2 hours", ["event_type"], {"total": ("SUM", "value", None), "top": ("MAX", "value", None)})
    got = drain(out, f"hourly_{uuid.uuid4().hex[:8]}")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "_count", F.round("total", 4).alias("total"), F.round("top", 4).alias("top"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drain(sessions(_events(spark, sf_dir), "ts", "6 hours", "12 hours", ["user_id"]), f"sessions_{uuid.uuid4().hex[:8]}")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("_count").alias("events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stream_hourly": stream_hourly, "stream_sessions": stream_sessions}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS _count, round(sum(value), 4) AS total, round(max(value), 4) AS top FROM events GROUP BY 1, 2",
        "stream_sessions": "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY 1",
    }
