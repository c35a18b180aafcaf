"""From files to searchable papers: intake, text, metadata, chunks, vectors.

Every stage is a table, so a stage can be written and rerun on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import heuristics, identifiers
from citespark.operators import chunks as ck
from citespark.operators import maintenance
from citespark.operators.metadata import resolve_metadata
from citespark.sources import files as fs

NO_TEXT = "Failed to extract text from file"


@dataclass
class Ingested:
    """New snapshots, and the files that were not taken."""

    papers: DataFrame
    chunks: DataFrame
    refused: DataFrame
    duplicates: DataFrame


def accept_files(files: DataFrame, papers: DataFrame, new_id=None):
    """New paper rows with content, refused files, duplicates."""
    good, refused = fs.ingest_files(files)
    fresh, duplicates = fs.dedupe_by_hash(good, papers)
    key = F.concat(F.lit("f-"), "file_hash") if new_id is None else new_id
    if new_id is None:
        # a later copy in the batch is the paper of the first one
        duplicates = duplicates.withColumn("paper_id", F.coalesce(F.col("paper_id").cast("string"), key))
    rows = fresh.withColumn("paper_id", key).join(
        good.select(F.col("path").alias("file_path"), "content", "extension"), "file_path"
    )
    return rows, refused, duplicates


def found_identifiers(papers: DataFrame) -> DataFrame:
    """Identifiers per paper from the whole text, the arXiv id also from the title."""
    merged = identifiers.merge_identifiers(
        identifiers.extract_identifiers(F.col("full_text")), identifiers.arxiv_in_title(F.col("title"))
    )
    return papers.select("paper_id", merged.alias("i")).select("paper_id", "i.arxiv_id", "i.doi", "i.pmid")


def guessed_metadata(papers: DataFrame, max_year: int) -> DataFrame:
    meta = heuristics.extract_metadata(F.col("full_text"), max_year)
    return papers.select("paper_id", meta.alias("m")).select(
        "paper_id", "m.title", "m.authors", "m.abstract", "m.year"
    )


def with_paper_fields(papers: DataFrame) -> DataFrame:
    """The table with all fields of a paper; missing ones are NULL."""
    for name, kind in (("authors", "array<string>"), ("abstract", "string"), ("year", "int"),
                       ("journal", "string"), ("doi", "string"), ("arxiv_id", "string")):
        if name not in papers.columns:
            papers = papers.withColumn(name, F.lit(None).cast(kind))
    return papers


def paper_records(
    readable: DataFrame, chunks: DataFrame, arxiv: DataFrame, works: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame], max_year: int,
) -> DataFrame:
    """Papers with a ``full_text``, their resolved metadata and their own vector."""
    resolved = resolve_metadata(
        readable, found_identifiers(readable), arxiv, works, guessed_metadata(readable, max_year)
    )
    first = ck.paper_embedding_text(resolved, chunks.select("paper_id", "chunk_index", "content"))
    return embed(first, "embedding_text").drop("embedding_text")


def process_papers(
    papers: DataFrame,
    arxiv: DataFrame,
    works: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    as_of: str,
    max_year: int = 2025,
) -> tuple[DataFrame, DataFrame]:
    """(paper rows, chunk rows) of papers with a ``full_text``; empty text is an error row."""
    has_text = F.coalesce(F.col("full_text"), F.lit("")) != ""
    readable = papers.filter(has_text)
    chunks = embed(ck.chunk_papers(readable), "content")
    vectors = paper_records(readable, chunks, arxiv, works, embed, max_year)
    stamp = F.expr(f"TIMESTAMP_NTZ '{as_of}'")
    done = vectors.withColumns(
        {"is_processed": F.lit(True), "processing_error": F.lit(None).cast("string"), "updated_at": stamp}
    )
    failed = papers.filter(~has_text).withColumns(
        {
            "is_processed": F.lit(False),
            "processing_error": F.lit(NO_TEXT),
            "updated_at": stamp,
        }
    )
    return done.unionByName(failed, allowMissingColumns=True), chunks


def ingest(
    files: DataFrame,
    papers: DataFrame,
    chunks: DataFrame,
    arxiv: DataFrame,
    works: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    as_of: str,
    decode: Callable[[DataFrame], DataFrame] = fs.decode_text,
) -> Ingested:
    """New paper and chunk snapshots after taking in a folder of files."""
    rows, refused, duplicates = accept_files(files, papers)
    text = with_paper_fields(decode(rows).drop("content", "extension", "processing_error"))
    done, fresh = process_papers(text, arxiv, works, embed, as_of)
    all_chunks = ck.replace_chunks(chunks, fresh, done) if chunks is not None else fresh
    all_papers = papers.unionByName(done, allowMissingColumns=True)
    return Ingested(all_papers, all_chunks, refused, duplicates)


def reprocess(
    papers: DataFrame,
    chunks: DataFrame,
    selected: DataFrame,
    arxiv: DataFrame,
    works: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    as_of: str,
) -> tuple[DataFrame, DataFrame]:
    """Snapshots after processing selected papers again from their stored text."""
    reset = maintenance.reset_for_processing(papers, selected)
    again = reset.join(selected.select("paper_id"), "paper_id", "left_semi")
    rest = reset.join(selected.select("paper_id"), "paper_id", "left_anti")
    done, fresh = process_papers(again, arxiv, works, embed, as_of)
    return (
        rest.unionByName(done, allowMissingColumns=True),
        ck.replace_chunks(chunks, fresh, selected),
    )
