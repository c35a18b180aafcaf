"""Library synchronisation: selecting libraries and items, planning, applying.

A plan row says what happens to an item: ``skip`` (stored version is not
older), ``update`` (known item: all mapped fields are overwritten), ``link``
(unknown item whose DOI is known: only empty fields are filled) or ``insert``.
Of several new items with one DOI the first in input order is inserted and the
others link to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPPED = ["title", "authors", "abstract", "year", "journal", "doi", "source_url"]


def parse_selection(configs: DataFrame, column: str, key: str = "user_id") -> DataFrame:
    """Selected collections of both stored formats: (user, position, key, library or NULL).

    A text is a JSON list of keys or of {key, libraryId}; bad JSON counts as empty.
    """
    items = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>")
    rows = configs.select(key, F.posexplode(items).alias("position", "_v"))
    collection = F.try_variant_get("_v", "$.key", "string")
    return rows.select(
        key,
        "position",
        F.coalesce(collection, F.try_variant_get("_v", "$", "string")).alias("collection_key"),
        F.when(collection.isNotNull(), F.try_variant_get("_v", "$.libraryId", "string")).alias("library_id"),
    )


def parse_groups(configs: DataFrame, column: str, key: str = "user_id") -> DataFrame:
    """Selected libraries as rows; bad JSON counts as empty."""
    items = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<string>")
    return configs.select(key, F.explode(items).alias("library_id"))


def libraries_to_fetch(
    configs: DataFrame, groups: DataFrame, selected: DataFrame, available: DataFrame, key: str = "user_id"
) -> DataFrame:
    """Libraries per user: selected groups, libraries of selected collections, all
    available ones when a selected collection names no library, and the personal
    library when nothing is selected (``configs``: user, personal_library;
    ``available``: user, library_id)."""
    named = selected.filter("library_id IS NOT NULL").select(key, "library_id")
    old_format = selected.filter("library_id IS NULL").select(key).distinct()
    personal = configs.select(key, F.col("personal_library").alias("library_id"))
    everything = available.select(key, "library_id").unionByName(personal).join(old_format, key, "left_semi")
    chosen = groups.select(key, "library_id").unionByName(named).unionByName(everything).distinct()
    any_choice = chosen.select(key).unionByName(selected.select(key)).distinct()
    return chosen.unionByName(personal.join(any_choice, key, "left_anti"))


def _selected_only(collections: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Collections that their user has selected: few of those that the libraries hold, so few are grouped.

    The distinct pairs are hashed, so that the collections pass them without being sorted.
    """
    wanted = selected.select(key, "collection_key").distinct()
    return collections.join(wanted.hint("shuffle_hash"), [key, "collection_key"], "left_semi")


def locate_collections(selected: DataFrame, collections: DataFrame, key: str = "user_id") -> DataFrame:
    """Library of every selected collection: the named one, else the last of the user's own
    libraries (in ``library_order``) that holds the key; keys found nowhere stay without a library."""
    last = _selected_only(collections, selected, key).groupBy(key, "collection_key").agg(
        F.max_by("library_id", "library_order").alias("_found")
    )
    return selected.join(last, [key, "collection_key"], "left").select(
        key, "position", "collection_key", F.coalesce("library_id", "_found").alias("library_id")
    )


def migrate_collections(selected: DataFrame, collections: DataFrame, key: str = "user_id") -> DataFrame:
    """All selected collections in the new format; for bare keys the first of the user's own
    libraries holding them counts, unknown bare keys are dropped."""
    first = _selected_only(collections, selected, key).groupBy(key, "collection_key").agg(
        F.min_by("library_id", "library_order").alias("_found")
    )
    return (
        selected.join(first, [key, "collection_key"], "left")
        .withColumn("library_id", F.coalesce("library_id", "_found"))
        .filter("library_id IS NOT NULL")
        .select(key, "position", "collection_key", "library_id")
    )


def collections_by_library(located: DataFrame, key: str = "user_id") -> DataFrame:
    """Collection keys per user and library; a selection is a short list."""
    return located.filter("library_id IS NOT NULL").groupBy(key, "library_id").agg(
        F.array_sort(F.collect_set("collection_key")).alias("collection_keys")
    )


def in_collections(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Items with at least one selected collection of their library."""
    hits = (
        items.select("library_id", "item_key", F.explode("collections").alias("collection_key"))
        .join(selected.select("library_id", "collection_key").distinct(), ["library_id", "collection_key"], "left_semi")
        .select("library_id", "item_key")
        .distinct()
    )
    return items.join(hits, ["library_id", "item_key"], "left_semi")


def modified_since(items: DataFrame, mark, column: str = "version", force_full: bool = False) -> DataFrame:
    """Items past the stored mark and items without a version; all of them without a mark or when forced."""
    if force_full or mark is None:
        return items
    return items.filter(F.col(column).isNull() | (F.col(column) > F.lit(mark)))


def merge_libraries(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several libraries as one table with their ``library_id``; nothing is dropped."""
    named = [df.withColumn("library_id", F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def item_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(F.count("*").alias("items"))


def first_attachment(papers: DataFrame, attachments: DataFrame) -> DataFrame:
    """Papers with the first PDF attachment in input order, NULL without one."""
    first = attachments.groupBy("parent_key").agg(
        F.min_by("attachment_key", "seq").alias("attachment_key"), F.count("*").alias("attachments")
    )
    return papers.join(first, papers["item_key"] == first["parent_key"], "left").drop("parent_key")


def sync_plan(items: DataFrame, sync_state: DataFrame, papers: DataFrame, user_id) -> DataFrame:
    """Action and target paper per item.

    ``items``: item_key, version, seq and the mapped fields; ``sync_state``:
    user_id, item_key, version, paper_id; paper ids are strings.
    """
    known = sync_state.filter(F.col("user_id") == user_id).select(
        "item_key", F.col("version").alias("_stored"), F.col("paper_id").alias("_synced")
    )
    rows = items.join(known, "item_key", "left").withColumn(
        "_state",
        F.when(F.col("_stored") >= F.col("version"), "skip")
        .when(F.col("_stored").isNotNull(), "update")
        .otherwise("unknown"),
    )
    # only unknown items with a DOI take part in DOI matching
    wanted = (F.col("_state") == "unknown") & F.col("doi").isNotNull()
    by_doi = papers.filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("paper_id").alias("_owner"))
    first_item = rows.filter(wanted).groupBy("doi").agg(F.min_by("item_key", "seq").alias("_first"))
    targets = first_item.join(by_doi, "doi", "left").select(
        F.col("doi").alias("_doi"), "_first", "_owner"
    )
    match = F.when(wanted, F.col("doi")).otherwise(F.concat(F.lit("\u0000"), "item_key"))
    rows = rows.withColumn("_match", match).join(
        targets, F.col("_match") == F.col("_doi"), "left"
    )
    fresh = F.concat(F.lit("new-"), F.coalesce("_first", "item_key"))
    action = (
        F.when(F.col("_state") != "unknown", F.col("_state"))
        .when(F.col("_owner").isNotNull(), "link")
        .when(F.col("_first") != F.col("item_key"), "link")
        .otherwise("insert")
    )
    return rows.select(
        *items.columns,
        action.alias("action"),
        F.coalesce("_synced", "_owner", fresh).alias("paper_id"),
    )


def sync_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("items"))


def _filled(column: str) -> Column:
    """A value that counts as present: not NULL, not '', not an empty list, not 0."""
    if column == "authors":
        return F.size(column) > 0
    if column == "year":
        return F.col(column) != 0
    return F.col(column) != ""


def apply_sync(papers: DataFrame, plan: DataFrame, source: str = "zotero") -> DataFrame:
    """New paper snapshot: updated, filled, inserted and untouched rows.

    Several links to one paper fill its gaps in input order, so per field the
    first present value wins; that is one aggregate, however many links a DOI has.
    """
    updates = plan.filter("action = 'update'").groupBy("paper_id").agg(
        *[F.max_by(c, "seq").alias(f"_u_{c}") for c in MAPPED], F.max_by("item_key", "seq").alias("_u_key")
    )
    gaps = plan.filter("action IN ('link', 'insert')").groupBy("paper_id").agg(
        *[F.min_by(c, F.when(_filled(c), F.col("seq"))).alias(f"_g_{c}") for c in MAPPED],
        F.min_by("item_key", "seq").alias("_g_key"),
        F.max(F.col("action") == "insert").alias("_insert"),
    )
    known = papers.join(updates, "paper_id", "left").join(gaps.drop("_insert"), "paper_id", "left")
    updated = F.col("_u_key").isNotNull()
    columns = {}
    for c in MAPPED:
        new = F.coalesce(f"_u_{c}", c) if c == "source_url" else F.col(f"_u_{c}")
        kept = F.when(F.coalesce(_filled(c), F.lit(False)), F.col(c)).otherwise(F.coalesce(f"_g_{c}", c))
        columns[c] = F.when(updated, new).otherwise(kept)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    columns["item_key"] = F.when(updated, F.col("_u_key")).otherwise(
        F.when(empty("item_key"), F.coalesce("_g_key", "item_key")).otherwise(F.col("item_key"))
    )
    columns["source"] = F.when(updated, F.lit(source)).otherwise(
        F.when(empty("source") & F.col("_g_key").isNotNull(), F.lit(source)).otherwise(F.col("source"))
    )
    columns["citation_count"] = F.when(updated, 0).otherwise(F.col("citation_count"))
    snapshot = known.withColumns(columns).select(*papers.columns)
    fresh = gaps.filter("_insert").select(
        "paper_id",
        *[F.col(f"_g_{c}").alias(c) for c in MAPPED],
        F.col("_g_key").alias("item_key"),
        F.lit(source).alias("source"),
        F.lit(0).alias("citation_count"),
    )
    return snapshot.unionByName(fresh, allowMissingColumns=True)


def changed_papers(papers: DataFrame, plan: DataFrame, source: str = "zotero") -> DataFrame:
    """The rows of :func:`apply_sync` that the plan changes or inserts, and no others."""
    touched = plan.filter("action <> 'skip'").select("paper_id").distinct()
    return apply_sync(papers.join(touched, "paper_id", "left_semi"), plan, source)


def changed_state(plan: DataFrame, user_id) -> DataFrame:
    """The rows that the plan adds to the state or replaces there: one per item, of its highest version."""
    changed = plan.filter("action <> 'skip'").groupBy("item_key").agg(
        F.max_by(F.struct("version", "paper_id"), F.struct("version", "seq")).alias("s")
    )
    return changed.select(F.lit(user_id).alias("user_id"), "item_key", "s.version", "s.paper_id")


def apply_sync_state(sync_state: DataFrame, plan: DataFrame, user_id) -> DataFrame:
    """New state: versions of updated items, rows for linked and inserted ones."""
    changed = plan.filter("action <> 'skip'").select(
        F.lit(user_id).alias("user_id"), "item_key", "version", "paper_id"
    )
    kept = sync_state.join(changed.select("user_id", "item_key"), ["user_id", "item_key"], "left_anti")
    return kept.select("user_id", "item_key", "version", "paper_id").unionByName(changed)


def split_failures(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable items, and rejects with a reason; one bad item stops nothing."""
    reason = (
        F.when(F.coalesce(F.col("item_key"), F.lit("")) == "", "no key")
        .when(F.col("version").isNull(), "no version")
        .when(F.length("title") > 1000, "title too long")
    )
    marked = items.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def high_water(plan: DataFrame, rejects: DataFrame, previous: int | None) -> DataFrame:
    """New mark: the highest version below every failed item, never below the old mark."""
    low = F.lit(previous).cast("long")
    failed = rejects.agg(F.min("version")).scalar()
    done = plan.filter(F.col("version") < F.coalesce(failed, F.col("version") + 1))
    return done.agg(F.greatest(F.max("version").cast("long"), low).alias("mark"))
