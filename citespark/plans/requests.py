"""Which messages of a message table become suggestion requests (batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import long_enough
from citespark.operators import timeline

WAIT_SECONDS = 0.5


def editor_requests(
    changes: DataFrame, wait_seconds: float = WAIT_SECONDS, user: str = "user_id", ts: str = "ts",
    text: str = "text", tie: str = "event_id",
) -> DataFrame:
    """Editor changes after which the user pauses, long enough and with new text."""
    quiet = timeline.debounce(changes, user, ts, wait_seconds, tie)
    usable = quiet.filter(long_enough(F.col(text)))
    return timeline.changed(usable, user, [ts, tie], text, timeline.time_bucket(ts))


def accepted_requests(messages: DataFrame, limit: int = 60, window_seconds: float = 60.0) -> DataFrame:
    """Messages within the rate limit; every message type counts, 'suggest' goes on."""
    flagged = timeline.rate_limit(messages, "user_id", "ts", "event_id", limit, window_seconds)
    return flagged.filter((F.col("type") == "suggest") & F.col("accepted") & long_enough(F.col("text")))
