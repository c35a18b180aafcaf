"""Scoring, relevance filter, per-paper cap and final order of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions import scoring
from citespark.functions.citations import display_text

SNIPPET_CHARS = 200
WORD_COLUMNS = ["previous_words", "paragraph_words", "title_words", "abstract_words"]


def score_candidates(candidates: DataFrame, as_of_year: int) -> DataFrame:
    """Adds the partial scores, relevance and band.

    Needs similarity, year, citation_count and either the word columns
    (previous_words, paragraph_words, title_words, abstract_words) or the texts
    they come from (previous_sentence, paragraph, title, abstract). venue_rank is
    used when present.
    """
    if set(WORD_COLUMNS) <= set(candidates.columns):
        context = scoring.context_score_of_words(*[F.col(c) for c in WORD_COLUMNS])
    else:
        texts = ("previous_sentence", "paragraph", "title", "abstract")
        context = scoring.context_score(*[F.col(c) for c in texts])
    rank = F.col("venue_rank") if "venue_rank" in candidates.columns else None

    def scores(context):
        quality = scoring.quality_score(F.col("citation_count"), rank)
        recency = scoring.recency_score(F.col("year"), as_of_year)
        return F.struct(
            context.alias("context_score"),
            quality.alias("quality_score"),
            recency.alias("recency_score"),
            scoring.relevance(F.col("similarity"), context, quality, recency).alias("relevance"),
        )

    kept = [c for c in candidates.columns if c not in WORD_COLUMNS]
    # as rows of a generator the scores are worked out once; as columns a filter on them would repeat them
    scored = candidates.select(*kept, F.inline_outer(F.transform(F.array(context), scores)))
    return scored.withColumn("band", scoring.confidence_band(F.col("relevance")))


def relevant(scored: DataFrame, min_relevance: float = scoring.MIN_RELEVANCE) -> DataFrame:
    return scored.filter(F.col("relevance") > min_relevance)


def cap_per_paper(
    candidates: DataFrame,
    max_chunks: int = 2,
    query_id: str = "query_id",
    paper_id: str = "paper_id",
    chunk_id: str = "chunk_id",
) -> DataFrame:
    """The ``max_chunks`` most similar rows of every (query, paper)."""
    order = Window.partitionBy(query_id, paper_id).orderBy(F.desc("similarity"), F.col(chunk_id))
    return (
        candidates.withColumn("_nth", F.row_number().over(order))
        .filter(F.col("_nth") <= max_chunks)
        .drop("_nth")
    )


def final_order(
    capped: DataFrame, top: int = 10, query_id: str = "query_id", chunk_id: str = "chunk_id"
) -> DataFrame:
    """Best ``top`` rows per query by relevance; ties keep the similarity order."""
    order = Window.partitionBy(query_id).orderBy(
        F.desc("relevance"), F.desc("similarity"), F.col(chunk_id)
    )
    return capped.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def rank_candidates(
    candidates: DataFrame,
    *,
    as_of_year: int,
    min_relevance: float = scoring.MIN_RELEVANCE,
    max_chunks: int = 2,
    top: int = 10,
) -> DataFrame:
    """Filter first, then cap by similarity, then order by relevance."""
    scored = score_candidates(candidates, as_of_year)
    return final_order(cap_per_paper(relevant(scored, min_relevance), max_chunks), top)


def snippet(content: str = "content", chars: int = SNIPPET_CHARS):
    text = F.col(content)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(
        text
    )


def suggestion_rows(ranked: DataFrame) -> DataFrame:
    """The fields a suggestion response carries, one row per suggestion."""
    return ranked.select(
        "query_id",
        "position",
        "paper_id",
        "title",
        "authors",
        "year",
        "abstract",
        F.col("relevance").alias("confidence"),
        F.lit("inline").alias("citation_style"),
        display_text(F.col("authors"), F.col("year")).alias("display_text"),
        snippet().alias("chunk_text"),
        "chunk_index",
        "chunk_id",
        "section_title",
        scoring.breakdown(
            F.col("similarity"), F.col("context_score"), F.col("quality_score"), F.col("recency_score")
        ).alias("relevance_scores"),
    )
