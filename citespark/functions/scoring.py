"""Relevance of a candidate chunk for a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.text import first_words, words

# Weights, thresholds and steps that decide the results.
WEIGHT_SIMILARITY = 0.40
WEIGHT_CONTEXT = 0.25
WEIGHT_QUALITY = 0.15
WEIGHT_RECENCY = 0.10
PREFERENCE_TERM = 0.05
MIN_RELEVANCE = 0.50
BAND_HIGH = 0.85
BAND_MEDIUM = 0.70
ABSTRACT_TOKENS = 50


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct tokens two arrays share."""
    return F.size(F.array_intersect(a, b))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def abstract_words(abstract: Column) -> Column:
    """Lower-cased first words of an abstract; only these are compared."""
    return F.transform(first_words(abstract, ABSTRACT_TOKENS), F.lower)


def context_score_of_words(
    previous_words: Column, paragraph_words: Column, title_words: Column, abstract_start: Column
) -> Column:
    """0.5, plus shared words of previous sentence/title and paragraph/abstract start.

    No words on the request's side add nothing, as no text does.
    """
    from_title = F.least(overlap(previous_words, title_words) * F.lit(0.1), F.lit(0.3))
    from_abstract = F.least(overlap(paragraph_words, abstract_start) * F.lit(0.02), F.lit(0.2))
    return F.lit(0.5) + from_title + from_abstract


def context_score(previous: Column, paragraph: Column, title: Column, abstract: Column) -> Column:
    return context_score_of_words(
        lower_words(previous), lower_words(paragraph), lower_words(title), abstract_words(abstract)
    )


def quality_score(citation_count: Column, venue_rank: Column | None = None) -> Column:
    rank = F.coalesce(F.lit("C") if venue_rank is None else venue_rank, F.lit("C"))
    cites = F.coalesce(citation_count, F.lit(0))
    by_cites = F.when(cites > 100, 0.3).when(cites > 10, 0.2).otherwise(0.0)
    by_venue = F.when(rank.isin("A", "A+"), 0.2).when(rank == "B", 0.1).otherwise(0.0)
    return F.least(F.lit(0.5) + by_cites + by_venue, F.lit(1.0))


def recency_score(year: Column, as_of_year: int) -> Column:
    """Steps up to ten years, then a slope; an unknown year counts as year 0."""
    age = F.lit(as_of_year) - F.coalesce(year, F.lit(0))
    slope = F.greatest(F.lit(0.3), F.lit(1.0) - age * F.lit(0.02))
    return F.when(age <= 2, 1.0).when(age <= 5, 0.8).when(age <= 10, 0.6).otherwise(slope)


def relevance(similarity: Column, context: Column, quality: Column, recency: Column) -> Column:
    total = (
        similarity * F.lit(WEIGHT_SIMILARITY)
        + context * F.lit(WEIGHT_CONTEXT)
        + quality * F.lit(WEIGHT_QUALITY)
        + recency * F.lit(WEIGHT_RECENCY)
        + F.lit(PREFERENCE_TERM)
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def confidence_band(value: Column) -> Column:
    """high / medium / low, NULL below the lowest band."""
    return (
        F.when(value > BAND_HIGH, "high")
        .when(value > BAND_MEDIUM, "medium")
        .when(value > MIN_RELEVANCE, "low")
    )


def breakdown(similarity: Column, context: Column, quality: Column, recency: Column) -> Column:
    """The four parts of a relevance value as one record."""
    return F.struct(
        similarity.alias("similarity"),
        context.alias("context"),
        quality.alias("quality"),
        recency.alias("recency"),
    )
