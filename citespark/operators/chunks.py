"""Chunk tables: building, replacing, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import chunking as ck
from citespark.functions import text as tx
from citespark.operators import timeline


def chunk_papers(
    papers: DataFrame,
    *,
    paper_id: str = "paper_id",
    text: str = "full_text",
    size: int = ck.CHUNK_WORDS,
    overlap: int = ck.OVERLAP_WORDS,
    exact_offsets: bool = False,
) -> DataFrame:
    """One row per chunk of every paper; a narrow job, no shuffle.

    See :func:`citespark.functions.chunking.chunk_records` for the fields.
    """
    records = ck.chunk_records(F.col(text), size, overlap, exact_offsets)
    return papers.select(F.col(paper_id).alias("paper_id"), F.inline(records))


def carry_section(chunks: DataFrame) -> DataFrame:
    """Fills missing section titles from the last titled chunk before."""
    filled = timeline.carry_forward(
        chunks, ["paper_id"], ["chunk_index"], "section_title",
        timeline.number_bucket("chunk_index"), "_section",
    )
    return filled.withColumn("section_title", F.col("_section")).drop("_section")


def replace_chunks(old: DataFrame, new: DataFrame, reprocessed: DataFrame) -> DataFrame:
    """New chunk snapshot: all chunks of reprocessed papers give way to the new ones."""
    kept = old.join(reprocessed.select("paper_id").distinct(), "paper_id", "left_anti")
    return kept.unionByName(new)


def overwrite_chunk_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions ``new`` touches."""
    (
        new.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def paper_chunk_listing(papers: DataFrame, chunks: DataFrame, preview_chars: int = 5000) -> DataFrame:
    """Chunks of a paper in index order beside text length, preview and chunk count."""
    counts = chunks.groupBy("paper_id").agg(F.count("*").alias("chunk_count"))
    head = papers.select(
        "paper_id",
        "title",
        F.substring("full_text", 1, preview_chars).alias("full_text"),
        tx.char_count(F.col("full_text")).alias("full_text_length"),
    )
    return (
        chunks.drop("title")
        .join(head, "paper_id", "right")
        .join(counts, "paper_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )


def chunks_per_paper(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count of every paper, and whether processing made no chunk."""
    counts = chunks.groupBy("paper_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return papers.join(counts, "paper_id", "left").select(
        "paper_id", n.alias("chunk_count"), (F.col("is_processed") & (n == 0)).alias("missing")
    )


def paper_embedding_text(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text a paper's own vector is made from: its abstract, else its first chunk."""
    first = chunks.filter("chunk_index = 0").select("paper_id", F.col("content").alias("_first"))
    text = F.coalesce(tx.empty_to_null(F.col("abstract")), F.col("_first"))
    return papers.join(first, "paper_id", "left").withColumn("embedding_text", text).drop("_first")
