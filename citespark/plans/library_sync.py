"""One synchronisation run: raw items in, new snapshots and counts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from citespark.operators import sync
from citespark.sources import library_items as li


@dataclass
class SyncRun:
    papers: DataFrame
    state: DataFrame
    plan: DataFrame
    counts: DataFrame
    rejects: DataFrame
    attachments: DataFrame
    mark: DataFrame


def run_sync(
    raw: DataFrame,
    papers: DataFrame,
    state: DataFrame,
    user_id,
    *,
    mark: int | None = None,
    force_full: bool = False,
    selected: DataFrame | None = None,
) -> SyncRun:
    """``raw``: item records with ``seq``; ``selected``: library_id, collection_key."""
    items, pdfs = li.split_items(raw)
    if selected is not None:
        from pyspark.sql import functions as F

        keyed = items.withColumn("item_key", F.col("key")).withColumn("collections", F.col("data.collections"))
        items = sync.in_collections(keyed, selected).drop("item_key", "collections")
    # before the mapping: it counts an item without a version as version 0, which is behind every mark
    mapped = li.map_items(sync.modified_since(items, mark, "version", force_full))
    good, rejects = sync.split_failures(mapped)
    good = good.drop("source", "citation_count")
    plan = sync.sync_plan(good, state, papers, user_id)
    return SyncRun(
        papers=sync.apply_sync(papers, plan),
        state=sync.apply_sync_state(state, plan, user_id),
        plan=plan,
        counts=sync.sync_counts(plan),
        rejects=rejects,
        attachments=sync.first_attachment(good, li.map_attachments(pdfs)),
        mark=sync.high_water(plan, rejects, mark),
    )
