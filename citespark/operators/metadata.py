"""Metadata resolution against reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators.keyed import one_per_key

FIELDS = ["title", "authors", "abstract", "year", "journal", "doi", "citation_count", "source_url"]


def _record(df: DataFrame, key: str, name: str) -> DataFrame:
    """Key and one record with all fields; missing ones are NULL."""
    types = {"authors": "array<string>", "year": "int", "citation_count": "int"}
    columns = [
        (F.col(f) if f in df.columns else F.lit(None)).cast(types.get(f, "string")).alias(f)
        for f in FIELDS
    ]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias(f"_{name}_key"), F.struct(*columns).alias(name))
    return one_per_key(rows, [f"_{name}_key"])


def _left_lookup(rows: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """Left join that never shuffles rows without a key into one partition.

    Equal keys hash to one task, and most rows may have no identifier at all;
    those get a spread-out key that matches nothing.
    """
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("paper_id"), F.lit(4096)).cast("string"))
    spread = rows.withColumn("_lookup", F.coalesce(F.col(column), filler))
    return spread.join(table, F.col("_lookup") == F.col(f"_{name}_key"), "left").drop(
        "_lookup", f"_{name}_key"
    )


def resolve_metadata(
    papers: DataFrame, identifiers: DataFrame, arxiv: DataFrame, works: DataFrame, guessed: DataFrame
) -> DataFrame:
    """One record per paper: arXiv entry, else works record, else the guess from text.

    The record is chosen as a whole; fields it lacks then keep the paper's own
    value. Identifiers found in the text are always kept.

    ``papers``: paper_id plus fields; ``identifiers``: paper_id, arxiv_id, doi;
    Of several rows with one key in a lookup table one counts (``one_per_key``).
    ``arxiv``: arxiv_id plus fields; ``works``: doi plus fields (``doi`` is the
    key); ``guessed``: paper_id plus fields.
    """
    found = one_per_key(identifiers.select(
        "paper_id", F.col("arxiv_id").alias("_found_arxiv"), F.col("doi").alias("_found_doi")
    ), ["paper_id"])
    rows = papers.join(found, "paper_id", "left")
    rows = _left_lookup(rows, "_found_arxiv", _record(arxiv, "arxiv_id", "_arxiv"), "_arxiv")
    rows = _left_lookup(rows, "_found_doi", _record(works, "doi", "_works"), "_works")
    text = _record(guessed, "paper_id", "_text").withColumnRenamed("__text_key", "paper_id")
    rows = rows.join(text, "paper_id", "left")
    source = (
        F.when(F.col("_arxiv").isNotNull(), "arxiv")
        .when(F.col("_works").isNotNull(), "crossref")
        .otherwise("text_extraction")
    )
    record = (
        F.when(F.col("_arxiv").isNotNull(), F.col("_arxiv"))
        .when(F.col("_works").isNotNull(), F.col("_works"))
        .otherwise(F.col("_text"))
    )
    rows = rows.withColumn("metadata_source", source).withColumn("_record", record)
    merged = {
        f: F.coalesce(F.col("_record")[f], F.col(f)) for f in FIELDS if f in papers.columns
    }
    if "doi" in merged:
        merged["doi"] = F.coalesce("_found_doi", merged["doi"])
    if "arxiv_id" in papers.columns:
        merged["arxiv_id"] = F.coalesce("_found_arxiv", "arxiv_id")
    return rows.withColumns(merged).drop(
        "_record", "_arxiv", "_works", "_text", "_found_arxiv", "_found_doi"
    )
