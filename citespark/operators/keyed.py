"""Lookup tables with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(table: DataFrame, keys: list[str], latest: str | Column | None = None) -> DataFrame:
    """One row per key, so that a left join on it never multiplies rows.

    Of several rows the one with the largest ``latest`` counts; without it, the
    one with the largest values, column by column from the left (NULL counts least).
    An aggregate combines on the map side, so a key with very many rows is no hot spot.
    """
    rest = [c for c in table.columns if c not in keys]
    if not rest:
        return table.select(*keys).distinct()
    row = F.struct(*rest)
    if latest is None:
        picked = F.max(row)
    else:
        order = F.col(latest) if isinstance(latest, str) else latest
        picked = F.max(F.struct(order.alias("_order"), row.alias("_row")))["_row"]
    grouped = table.groupBy(*keys).agg(picked.alias("_row"))
    return grouped.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*table.columns)
