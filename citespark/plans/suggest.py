"""Suggestions for a table of requests: search, join, score, cap, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import text as tx
from citespark.functions.scoring import abstract_words, lower_words
from citespark.operators import ranking
from citespark.operators.similarity import similarity_join

CANDIDATES = 30
MIN_SIMILARITY = 0.4
BATCH_CANDIDATES = 10
BATCH_MIN_SIMILARITY = 0.5


def searchable_papers(
    papers: DataFrame,
    year_from: int | None = None,
    year_to: int | None = None,
    min_citations: int | None = None,
) -> DataFrame:
    """Processed papers within the optional year and citation limits."""
    keep = F.col("is_processed")
    if year_from is not None:
        keep &= F.col("year") >= year_from
    if year_to is not None:
        keep &= F.col("year") <= year_to
    if min_citations is not None:
        keep &= F.col("citation_count") >= min_citations
    return papers.filter(keep)


def candidate_chunks(
    requests: DataFrame,
    chunks: DataFrame,
    papers: DataFrame,
    *,
    limit: int = CANDIDATES,
    min_similarity: float = MIN_SIMILARITY,
    **physical: int,
) -> DataFrame:
    """Most similar chunks of allowed papers with what their scores need.

    Only paper ids meet the whole chunk table. Candidates stay narrow: words
    instead of texts, split once per paper and once per request; the wide
    columns are fetched for the final rows alone.
    """
    vectors = chunks.select("chunk_id", "paper_id", "embedding").join(
        papers.select("paper_id"), "paper_id", "left_semi"
    )
    best = similarity_join(
        requests, vectors, k=limit, min_similarity=min_similarity, **physical
    )
    # words are split for papers that have chunks only
    facts = papers.join(chunks.select("paper_id").distinct(), "paper_id", "left_semi").select(
        "paper_id",
        "year",
        "citation_count",
        lower_words(F.col("title")).alias("title_words"),
        abstract_words(F.col("abstract")).alias("abstract_words"),
    )
    context = requests.select(
        "query_id",
        lower_words(F.col("previous_sentence")).alias("previous_words"),
        lower_words(F.col("paragraph")).alias("paragraph_words"),
    )
    found = best.join(chunks.select("chunk_id", "paper_id"), "chunk_id").join(facts, "paper_id")
    # the exchange by request that the rank windows need anyway, placed before the
    # scoring: candidates of a hot paper or chunk file are scored by many tasks
    return found.join(context, "query_id").repartition("query_id")


def with_details(ranked: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Final rows with chunk texts and paper fields."""
    texts = chunks.select("chunk_id", "content", "chunk_index", "section_title")
    wide = papers.select("paper_id", "title", "authors", "year", "abstract", "journal", "doi")
    return ranked.drop("year").join(texts, "chunk_id").join(wide, "paper_id")


def suggest(
    requests: DataFrame,
    chunks: DataFrame,
    papers: DataFrame,
    *,
    as_of_year: int,
    limit: int = CANDIDATES,
    min_similarity: float = MIN_SIMILARITY,
    min_relevance: float = ranking.scoring.MIN_RELEVANCE,
    max_chunks: int = 2,
    top: int = 10,
    year_from: int | None = None,
    year_to: int | None = None,
    min_citations: int | None = None,
    **physical: int,
) -> DataFrame:
    """Ranked suggestions of all requests in one job.

    ``requests``: query_id, embedding, previous_sentence, paragraph;
    ``chunks``: chunk_id, paper_id, content, chunk_index, section_title, embedding.
    """
    allowed = searchable_papers(papers, year_from, year_to, min_citations)
    found = candidate_chunks(
        requests, chunks, allowed, limit=limit, min_similarity=min_similarity, **physical
    )
    ranked = ranking.rank_candidates(
        found, as_of_year=as_of_year, min_relevance=min_relevance, max_chunks=max_chunks, top=top
    )
    return ranking.suggestion_rows(with_details(ranked, chunks, allowed))


def suggest_batch(requests: DataFrame, chunks: DataFrame, papers: DataFrame, *, as_of_year: int,
                  min_similarity: float = BATCH_MIN_SIMILARITY, **options) -> DataFrame:
    """Batch defaults: fewer candidates, a higher threshold, five suggestions."""
    return suggest(
        requests, chunks, papers, as_of_year=as_of_year, limit=BATCH_CANDIDATES,
        min_similarity=min_similarity, top=5, **options,
    )


def requests_from_text(messages: DataFrame, embed, text: str = "text") -> DataFrame:
    """Request rows from raw messages (query_id, text[, cursor, section]).

    Texts under the minimum length are dropped; ``embed`` maps a table and a
    text column to the same table with an ``embedding`` column.
    """
    cursor = F.col("cursor") if "cursor" in messages.columns else None
    section = F.col("section") if "section" in messages.columns else None
    context = tx.extract_context(F.col(text), cursor, section)
    prepared = messages.filter(tx.long_enough(F.col(text))).withColumn("context", context)
    flat = prepared.select(
        "query_id",
        F.col("context.current_sentence").alias("current_sentence"),
        F.col("context.previous_sentence").alias("previous_sentence"),
        F.col("context.paragraph").alias("paragraph"),
    )
    return embed(flat, "current_sentence")
