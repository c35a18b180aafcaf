"""Window work that stays balanced when one key holds a large share of all rows.

A plain ``partitionBy(key)`` window puts a hot key into one task. Here every
key is also cut into buckets along its order. Row-level windows run per
(key, bucket); what crosses a bucket border comes either from a halo (rows
repeated into the neighbouring bucket, for windows of bounded width) or from
one summary row per bucket, which is what a per-key window then runs over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
# short enough that a bucket of a hot key stays small, however long its history is
BUCKET_MICROS = 60 * MICROS
ORDER_BUCKET = 4096
HALO_SPANS = 32


def micros(ts: str) -> Column:
    """Microseconds of a naive timestamp, whatever the session time zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def number_bucket(order: str, size: int = ORDER_BUCKET) -> Column:
    return F.floor(F.col(order) / size)


def ranked_buckets(df: DataFrame, order: str, out: str = "_bucket", size: int = ORDER_BUCKET, most: int = 4096) -> DataFrame:
    """``df`` with buckets of about ``size`` rows by ascending ``order``, however its values are spread.

    Borders are quantiles of the column: at most ``most`` numbers, whatever the
    table holds. Rows without a value are in the first bucket, as they are first in order.
    """
    from pyspark.ml.feature import Bucketizer

    value = F.col(order).cast("double")
    n = min(most, -(-df.filter(value.isNotNull()).count() // size))
    if n < 2:
        return df.withColumn(out, F.lit(0))
    wide = df.withColumn("_value", value)
    borders = sorted(set(wide.approxQuantile("_value", [k / n for k in range(1, n)], 1 / (4 * n))))
    cut = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol="_value", outputCol="_place", handleInvalid="keep")
    placed = cut.transform(wide)
    bucket = F.when(F.col("_value").isNull(), -1).otherwise(F.col("_place").cast("int"))
    return placed.withColumn(out, bucket).drop("_value", "_place")


def time_bucket(ts: str, width_micros: int = BUCKET_MICROS) -> Column:
    return F.floor(micros(ts) / width_micros)


def _order(order: list[str]) -> list[Column]:
    return [F.col(c) for c in order]


def _order_key(order: list[str]) -> Column:
    return F.struct(*_order(order))


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` up to and including each row."""
    df = df.withColumn("_bucket", bucket)
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*_order(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summary = df.groupBy(*keys, "_bucket").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), _order_key(order))).alias("_tail")
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = summary.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    return (
        df.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
        .join(summary, [*keys, "_bucket"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", "_bucket")
    )


def _neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: Column, prefix: str,
    forward: bool,
) -> DataFrame:
    df = df.withColumn("_bucket", bucket)
    row = F.struct(*[F.col(v) for v in values])
    pick, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    summary = df.groupBy(*keys, "_bucket").agg(pick(row, _order_key(order)).alias("_edge"))
    summary = summary.withColumn(
        "_outer", shift("_edge").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ).drop("_edge")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order))
    joined = df.withColumn("_inner", shift(row).over(inside)).join(summary, [*keys, "_bucket"])
    found = F.coalesce("_inner", "_outer")
    for v in values:
        joined = joined.withColumn(f"{prefix}{v}", found[v])
    return joined.drop("_inner", "_outer", "_bucket")


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: Column
) -> DataFrame:
    """``prev_<value>`` of the row before, NULL for the first row of a key."""
    return _neighbour(df, keys, order, values, bucket, "prev_", forward=False)


def next_row(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: Column
) -> DataFrame:
    """``next_<value>`` of the row after, NULL for the last row of a key."""
    return _neighbour(df, keys, order, values, bucket, "next_", forward=True)


def running_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, out: str
) -> DataFrame:
    """``row_number`` per key, counted per bucket plus the counts of earlier buckets.

    Without a ``bucket`` rows are dealt by their rank in the first column of the order.
    """
    df = ranked_buckets(df, order[0]) if bucket is None else df.withColumn("_bucket", bucket)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order))
    return (
        df.withColumn("_inner", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_inner") + F.col("_offset")).cast("long"))
        .drop("_inner", "_offset", "_bucket")
    )


def _with_halo(df: DataFrame, ts: str, width: int, side: int) -> DataFrame:
    """Rows in their own bucket; those within ``width`` of the border to the bucket
    ``side`` away are repeated there as context. Buckets are many widths long, so
    few rows are repeated."""
    span = width * HALO_SPANS
    within = F.pmod(F.col("_t"), F.lit(span))
    near = within >= span - width if side > 0 else within < width
    places = F.when(near, F.array(F.lit(0), F.lit(side))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("_t", micros(ts))
        .withColumn("_shift", F.explode(places))
        .withColumn("_bucket", F.floor(F.col("_t") / span) + F.col("_shift"))
    )


def sliding_count(
    df: DataFrame, key: str, ts: str, window_seconds: float, out: str = "recent"
) -> DataFrame:
    """Rows of the same key less than ``window_seconds`` old, the row itself included."""
    width = int(window_seconds * MICROS)
    w = Window.partitionBy(key, "_bucket").orderBy("_t").rangeBetween(-(width - 1), 0)
    return (
        _with_halo(df, ts, width, 1)
        .withColumn(out, F.count("*").over(w))
        .filter("_shift = 0")
        .drop("_t", "_shift", "_bucket")
    )


def debounce(df: DataFrame, key: str, ts: str, wait_seconds: float, tie: str) -> DataFrame:
    """Rows after which the key stays silent for at least ``wait_seconds``."""
    width = int(wait_seconds * MICROS)
    w = Window.partitionBy(key, "_bucket").orderBy("_t", tie)
    gap = F.lead("_t").over(w) - F.col("_t")
    return (
        _with_halo(df, ts, width, -1)
        .withColumn("_gap", gap)
        .filter((F.col("_shift") == 0) & (F.col("_gap").isNull() | (F.col("_gap") >= width)))
        .drop("_t", "_shift", "_bucket", "_gap")
    )


def changed(df: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """Rows whose value differs from the row before of the same key."""
    seen = previous_row(df, [key], order, [value], bucket)
    return seen.filter(~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).drop(f"prev_{value}")


def rate_limit(
    df: DataFrame, key: str, ts: str, tie: str, limit: int = 60, window_seconds: float = 60.0
) -> DataFrame:
    """``accepted`` flag: at most ``limit`` accepted rows of a key in the last window.

    Rejected rows do not count, so the exact rule is sequential. A silence of a
    full window clears its state: the pieces between silences are independent,
    and a piece whose plain sliding count never passes the limit is accepted as
    a whole. Only the other pieces are replayed in order, with ``limit``
    timestamps as the whole state.
    """
    width = int(window_seconds * MICROS)
    counted = sliding_count(df, key, ts, window_seconds, "_recent").withColumn("_t", micros(ts))
    seen = previous_row(counted, [key], ["_t", tie], ["_t"], time_bucket(ts))
    first = F.col("prev__t").isNull() | (F.col("_t") - F.col("prev__t") >= width)
    seen = seen.withColumn("_start", F.when(first, F.col("_t"))).drop("prev__t")
    pieces = carry_forward(
        seen, [key], ["_t", tie], "_start", time_bucket(ts), "_piece"
    ).drop("_start")
    worst = pieces.groupBy(key, "_piece").agg(F.max("_recent").alias("_worst"))
    pieces = pieces.join(worst, [key, "_piece"])
    easy = pieces.filter(F.col("_worst") <= limit).withColumn("accepted", F.lit(True))
    hard = (
        pieces.filter(F.col("_worst") > limit)
        .withColumn("accepted", F.lit(False))
        .repartition(key, "_piece")
        .sortWithinPartitions(key, "_piece", "_t", tie)
    )

    def replay(batches):
        current, accepted = None, []
        for pdf in batches:
            flags = []
            for who, piece, now in zip(pdf[key], pdf["_piece"], pdf["_t"], strict=True):
                if (who, piece) != current:
                    current, accepted = (who, piece), []
                accepted = [t for t in accepted if now - t < width]
                flags.append(len(accepted) < limit)
                if flags[-1]:
                    accepted.append(now)
            pdf["accepted"] = flags
            yield pdf

    replayed = hard.mapInPandas(replay, hard.schema)
    return easy.unionByName(replayed).drop("_t", "_recent", "_piece", "_worst")
