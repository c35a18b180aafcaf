"""Snapshots after deletes and updates, and integrity checks.

Every operator returns new tables; nothing is changed in place, so a failed
job leaves the old snapshot whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.operators.keyed import one_per_key
from citespark.operators.logs import CATEGORIES, LEVELS

from citespark.functions.text import empty_to_null

IDENTIFIERS = ["doi", "arxiv_id", "pubmed_id", "semantic_scholar_id"]
DOCUMENT_CHILDREN = ["citations", "assignments"]
PAPER_CHILDREN = ["chunks", "citations", "assignments", "sync_state", "library_papers"]


def bulk_delete(documents: DataFrame, requested: DataFrame, user_id) -> tuple[DataFrame, DataFrame]:
    """Snapshot without the requested own documents, and (deleted, requested) counts."""
    wanted = requested.select("document_id").distinct()
    doomed = documents.filter(F.col("owner_id") == user_id).join(wanted, "document_id", "left_semi")
    rest = documents.join(doomed.select("document_id"), "document_id", "left_anti")
    counts = doomed.agg(F.count("*").alias("deleted_count")).withColumn(
        "requested_count", requested.agg(F.count("*")).scalar()
    )
    return rest, counts


def cascade(
    deleted: DataFrame, children: dict[str, DataFrame], key: str
) -> dict[str, DataFrame]:
    """Child tables without rows of deleted parents."""
    gone = deleted.select(key).distinct()
    return {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [
        table.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def clear_tables(
    tables: dict[str, DataFrame], as_of: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty snapshots with the old schemas, and a log row with the counts per table."""
    empty = {name: table.limit(0) for name, table in tables.items()}
    log = table_counts(tables).select(
        F.lit("WARNING").alias("level"),
        F.lit("SYSTEM").alias("category"),
        F.concat(F.lit("cleared "), "table_name", F.lit(": "), F.col("n").cast("string")).alias("message"),
        F.expr(f"TIMESTAMP_NTZ '{as_of}'").alias("created_at"),
    )
    return empty, log


def normalise_identifiers(papers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty identifiers become NULL."""
    names = columns or [c for c in IDENTIFIERS if c in papers.columns]
    return papers.withColumns({c: empty_to_null(F.col(c)) for c in names})


def _rule(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))


def unique(table: DataFrame, columns: list[str]) -> DataFrame:
    """Number of key values that occur more than once; NULL keys never clash."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    twice = table.filter(filled).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return _rule(f"unique ({', '.join(columns)})", twice)


def no_orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    return _rule(f"{name} without parent", child.join(parent.select(key), key, "left_anti"))


def vector_length(table: DataFrame, dim: int) -> DataFrame:
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    return _rule(f"vector length {dim}", table.filter(wrong))


def _counted(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all counted in one pass over the table."""
    counts = table.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(rules.values())])
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def unique_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """``unique`` for several single columns in one pass; NULL and '' never clash."""
    names = {c: f"unique ({c})" for c in columns}
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(c).cast("string").alias("value")) for c, r in names.items()]
    )
    copies = (
        table.select(F.inline(pairs))
        .filter("value <> ''")
        .groupBy("rule", "value")
        .agg(F.count("*").alias("n"))
        .select("rule", (F.col("n") > 1).cast("long").alias("twice"))
    )
    # every rule has a row, also when its column is empty
    listed = table.sparkSession.createDataFrame([(r, 0) for r in names.values()], "rule string, twice long")
    return copies.unionByName(listed).groupBy("rule").agg(F.sum("twice").alias("violations"))


def check_constraints(
    papers: DataFrame, assignments: DataFrame, sync_state: DataFrame, chunks: DataFrame, dim: int,
    logs: DataFrame | None = None,
) -> DataFrame:
    """Violation counts of all rules in one table; with ``logs`` also of its closed value sets."""
    names = [c for c in IDENTIFIERS if c in papers.columns]
    paper_rules = {f"{c} not empty": F.col(c) == "" for c in names}
    paper_rules["year 1900 to 2100"] = ~F.col("year").between(1900, 2100)
    parts = [
        _counted(papers, paper_rules),
        unique_columns(papers, names),
        unique(assignments, ["document_id", "paper_id"]),
        unique(sync_state, ["user_id", "item_key"]),
        no_orphans(assignments, papers, "paper_id", "assignment"),
        no_orphans(chunks, papers, "paper_id", "chunk"),
        vector_length(chunks, dim),
    ]
    if logs is not None:
        sets = {"level": LEVELS, "category": CATEGORIES}
        # a missing value is outside of the set, too
        parts.append(_counted(logs, {f"log {c}": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in sets.items()}))
    return reduce(DataFrame.unionByName, parts)


def apply_outcomes(papers: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Processed or failed per paper (``error`` NULL means success); of several outcomes one error makes a failure."""
    done = outcomes.groupBy("paper_id").agg(F.max("error").alias("_error")).withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    return papers.join(done, "paper_id", "left").withColumns(
        {
            "is_processed": F.when(hit, F.col("_error").isNull()).otherwise(F.col("is_processed")),
            "processing_error": F.when(hit, F.col("_error")).otherwise(F.col("processing_error")),
            "updated_at": F.when(hit, F.expr(f"TIMESTAMP_NTZ '{as_of}'")).otherwise(F.col("updated_at")),
        }
    ).drop("_error", "_done")


def reset_for_processing(papers: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected papers become unprocessed without an error."""
    marked = selected.select("paper_id").distinct().withColumn("_redo", F.lit(True))
    hit = F.col("_redo").isNotNull()
    return papers.join(marked, "paper_id", "left").withColumns(
        {
            "is_processed": ~hit & F.col("is_processed"),
            "processing_error": F.when(~hit, F.col("processing_error")),
        }
    ).drop("_redo")


def merge_metadata(papers: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """Resolved values where present, the paper's own values elsewhere; one record per paper counts (``one_per_key``)."""
    new = one_per_key(resolved.select("paper_id", *fields), ["paper_id"]).select("paper_id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    out = papers.join(new, "paper_id", "left")
    return out.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(
        *[f"_new_{f}" for f in fields]
    )
