"""The event log: filtering, statistics, retention, appending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import contains_pattern

# The closed sets of a log row.
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
CATEGORIES = ["ZOTERO_SYNC", "PDF_PROCESSING", "SYSTEM", "AUTH", "API", "DATABASE", "SEARCH"]


def cutoff(as_of: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days}' DAY")


def filter_logs(
    logs: DataFrame,
    *,
    level: str | None = None,
    category: str | None = None,
    user_id=None,
    entity_type: str | None = None,
    entity_id: str | None = None,
    start: str | None = None,
    end: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Conjunction of the given predicates; absent ones do not restrict."""
    wanted = {
        "level": level,
        "category": category,
        "user_id": user_id,
        "entity_type": entity_type,
        "entity_id": entity_id,
    }
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if start is not None:
        tests.append(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{start}'"))
    if end is not None:
        tests.append(F.col("created_at") <= F.expr(f"TIMESTAMP_NTZ '{end}'"))
    if search is not None:
        tests.append(contains_pattern(F.col("message"), search))
    return logs.filter(reduce(lambda a, b: a & b, tests)) if tests else logs


def own_logs(logs: DataFrame, current_user, is_superuser: bool, user_id=None) -> DataFrame:
    """Superusers choose the user, all others see their own rows."""
    return filter_logs(logs, user_id=user_id if is_superuser else current_user)


def log_stats(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Total, per level and per category since ``days`` ago, in one pass."""
    recent = logs.filter(F.col("created_at") >= cutoff(as_of, days))
    level, category = F.col("level"), F.col("category")
    return (
        recent.groupingSets([[level], [category], []], level, category)
        .agg(F.grouping_id().alias("_gid"), F.count("*").alias("logs"))
        .select(
            F.when(F.col("_gid") == 1, "level").when(F.col("_gid") == 2, "category").otherwise("total").alias("kind"),
            F.coalesce("level", "category", F.lit("all")).alias("name"),
            "logs",
        )
    )


def windowed_counts(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts per window, level and category; batch and streaming alike."""
    return logs.groupBy(F.window("created_at", width).alias("w"), "level", "category").agg(
        F.count("*").alias("logs")
    ).select(F.col("w.start").alias("window_start"), "level", "category", "logs")


def logs_with_users(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows with the user's e-mail, NULL for rows without a user."""
    return logs.join(users.select("user_id", "email"), "user_id", "left")


def purge_logs(logs: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Snapshot without rows older than ``days``, and the count of the removed ones."""
    old = F.col("created_at") < cutoff(as_of, days)
    return logs.filter(~old), logs.agg(F.count_if(old).alias("deleted_count"))


def log_rows(outcomes: DataFrame, category: str, message: Column, as_of: str) -> DataFrame:
    """Log rows of job outcomes (entity_id, error_type, error_message, error_trace).

    Rows with an error become ERROR rows with type and message in the details.
    """
    failed = F.col("error_message").isNotNull()
    details = F.when(failed, F.to_json(F.struct("error_type", "error_message")))
    return outcomes.select(
        F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.lit(category).alias("category"),
        message.alias("message"),
        details.alias("details"),
        F.when(failed, F.col("error_trace")).alias("error_trace"),
        F.lit("paper").alias("entity_type"),
        F.col("entity_id").cast("string").alias("entity_id"),
        F.expr(f"TIMESTAMP_NTZ '{as_of}'").alias("created_at"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_logs(logs: DataFrame, path: str, **filters) -> None:
    """Filtered logs as JSON lines."""
    filter_logs(logs, **filters).write.mode("overwrite").json(path)


def log_json(logs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON text per log row, of the level, category and message or of the ``fields`` named; NULL fields are left out."""
    return logs.select("log_id", F.to_json(F.struct(*(fields or ["level", "category", "message"]))).alias("line"))
