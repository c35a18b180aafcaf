"""Windowed log statistics on a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators.logs import windowed_counts

DELAY = "1 hour"


def log_stream(logs: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Counts per window, level and category; rows later than ``delay`` are dropped."""
    timed = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return windowed_counts(timed.withWatermark("created_at", delay), width)
