"""Request streams: debounce, rate limit, suggestions.

Event times come from the messages. The rate limit answers every message, late ones
too; where bursts are formed, rows later than the watermark are dropped. That rule is
ours, the batch forms know no late data.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citespark.functions.text import MIN_REQUEST_CHARS, long_enough
from citespark.plans.suggest import requests_from_text, suggest

WAIT_MS = 500
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60.0


def debounce_sessions(changes: DataFrame, wait_ms: int = WAIT_MS, delay: str = "10 seconds") -> DataFrame:
    """Last text of every burst; a burst ends with ``wait_ms`` of silence of the user.

    Session windows that touch are merged, so the gap is a microsecond shorter:
    a change exactly ``wait_ms`` after another starts a burst of its own.
    """
    gap = f"{wait_ms * 1000 - 1} microseconds"
    return (
        changes.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.max_by(F.struct("ts", "text"), F.struct("ts", "event_id")).alias("_last"))
        .select("user_id", F.col("_last.ts").alias("ts"), F.col("_last.text").alias("text"))
    )


def _micros(value) -> int:
    return int(pd.Timestamp(value).value // 1000)


def debounce_stream(changes: DataFrame, wait_ms: int = WAIT_MS, delay: str = "10 seconds") -> DataFrame:
    """Debounced, long enough texts that differ from the user's last request.

    State per user: the pending change and the text requested last.
    """
    wait = wait_ms * 1000

    def passes(text: str, emitted: str | None) -> bool:
        return len((text or "").strip()) >= MIN_REQUEST_CHARS and text != emitted

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, text, emitted = state.get if state.exists else (None, None, None)
        out: list[tuple] = []

        def release():
            nonlocal emitted
            if pending is not None and passes(text, emitted):
                out.append((key[0], pd.Timestamp(pending, unit="us"), text))
                emitted = text

        if state.hasTimedOut:
            release()
            pending, text = None, None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, new_text in zip(rows["ts"], rows["text"], strict=True):
                now = _micros(ts)
                if pending is not None and now - pending >= wait:
                    release()
                pending, text = now, new_text
        state.update((pending, text, emitted))
        if pending is not None:
            due = (pending + wait) // 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "ts", "text"])

    user_type = changes.schema["user_id"].dataType.simpleString()
    return (
        changes.withWatermark("ts", delay)
        .groupBy("user_id")
        .applyInPandasWithState(
            step,
            f"user_id {user_type}, ts timestamp, text string",
            "pending bigint, text string, emitted string",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def judge(accepted: list[int], now: int, width: int, limit: int) -> bool:
    """Whether one more message at ``now`` leaves at most ``limit`` accepted ones in every window; if so it joins them.

    ``accepted`` ascends. For a message that is newer than all of them this is the
    plain rule; an older one must not push a later window over the limit either.
    """
    place = bisect_right(accepted, now)
    later = [t for t in accepted[place:] if t - now < width]
    for end in (now, *later):
        held = bisect_right(accepted, end) - bisect_right(accepted, end - width)
        if held >= limit:
            return False
    accepted.insert(place, now)
    return True


def rate_limit_stream(
    messages: DataFrame,
    limit: int = RATE_LIMIT,
    window_seconds: float = RATE_WINDOW_SECONDS,
    delay: str = "10 seconds",
    idle_ms: int | None = None,
) -> DataFrame:
    """Every message with an ``accepted`` flag and whether it came ``late`` (behind a newer one of its user).

    No message is dropped. Late ones are judged by the windows that they fall
    into; one that is older than a window and ``delay`` behind the newest cannot be
    judged any more and is refused. State per user: the accepted times of that
    span, at most ``limit`` for each window of it. With ``idle_ms`` it goes after so
    much processing time without a message; such a stream looks for idle users all
    the time, so it is for continuous triggers and does not end by itself.
    """
    width = int(window_seconds * 1_000_000)
    span = width + int(pd.Timedelta(delay).value // 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted, newest = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        flags, late = [], []
        for ts in rows["ts"]:
            now = _micros(ts)
            late.append(newest is not None and now < newest)
            newest = now if newest is None else max(newest, now)
            flags.append(now > newest - span and judge(accepted, now, width, limit))
            accepted = accepted[bisect_right(accepted, newest - span - width) :]
        state.update((accepted, newest))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(accepted=flags, late=late)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in messages.schema]
    return messages.groupBy("user_id").applyInPandasWithState(
        step,
        ", ".join([*fields, "accepted boolean", "late boolean"]),
        "accepted array<bigint>, newest bigint",
        "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def suggest_batch_of(
    messages: DataFrame,
    chunks: DataFrame,
    papers: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    as_of_year: int,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(suggestions, rejected messages with a reason) of one batch of messages."""
    reason = (
        F.when(F.col("type") != "suggest", "unknown type")
        .when(F.col("query_id").isNull() | F.col("text").isNull(), "incomplete message")
        .when(~long_enough(F.col("text")), "text too short")
    )
    marked = messages.withColumn("reason", reason)
    good = marked.filter("reason IS NULL").drop("reason")
    requests = requests_from_text(good, embed)
    return (
        suggest(requests, chunks, papers, as_of_year=as_of_year, **options),
        marked.filter("reason IS NOT NULL").select("query_id", "type", "text", "reason"),
    )


def suggest_stream(
    messages: DataFrame,
    chunks: DataFrame,
    papers: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    *,
    as_of_year: int,
    out: str,
    rejects: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
):
    """Starts the stream: each micro-batch runs the batch plan and writes its own partition.

    A batch that is repeated after a failure overwrites the same partition, so
    every request is answered once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        found, bad = suggest_batch_of(batch, chunks, papers, embed, as_of_year, **options)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
