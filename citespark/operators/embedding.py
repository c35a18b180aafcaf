"""Embedding of text columns: distinct texts first, cached vectors reused.

An embedder is any function from a pandas Series of strings to a list of
vectors. It runs in Arrow batches inside the tasks. The default needs no model:
hashed bag of words with unit length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import text_key

Embedder = Callable[[pd.Series], "list[np.ndarray]"]
DIMENSIONS = 384
BATCH_TEXTS = 32


def hashed_embedder(dim: int = DIMENSIONS) -> Embedder:
    """Counts of lower-cased tokens in md5 buckets, scaled to unit length."""

    def embed(texts: pd.Series) -> list[np.ndarray]:
        buckets: dict[str, int] = {}
        out = []
        for tokens in texts.str.lower().str.split():
            for token in tokens:
                if token not in buckets:
                    buckets[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            counts = np.bincount([buckets[x] for x in tokens], minlength=dim).astype(np.float64)
            length = np.linalg.norm(counts)
            out.append((counts / length if length else counts).astype(np.float32))
        return out

    return embed


def embed_texts(texts: DataFrame, text: str, embedder: Embedder, batch: int = BATCH_TEXTS) -> DataFrame:
    """Adds ``embedding``; the model sees at most ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            vectors = []
            for lo in range(0, len(series), batch):
                vectors.extend(embedder(series.iloc[lo : lo + batch]))
            yield pd.Series(vectors, dtype=object)

    return texts.withColumn("embedding", run(F.col(text)))


def embed_with_cache(
    df: DataFrame, text: str, embedder: Embedder, cache: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table with vectors, and the (text_key, embedding) rows new to the cache.

    Each distinct text is embedded once, however often it occurs.
    """
    keyed = df.drop("embedding").withColumn("text_key", text_key(F.col(text)))
    distinct = keyed.filter(F.col(text).isNotNull()).groupBy("text_key").agg(F.first(text).alias("_text"))
    if cache is not None:
        distinct = distinct.join(cache.select("text_key"), "text_key", "left_anti")
    fresh = embed_texts(distinct, "_text", embedder).select("text_key", "embedding")
    known = fresh if cache is None else fresh.unionByName(cache.select("text_key", "embedding"))
    return keyed.join(known, "text_key", "left").drop("text_key"), fresh


def embedding_with(embedder: Embedder, cache: DataFrame | None = None):
    """``embed(table, text column)`` for plans that take an embedding step."""
    return lambda df, text: embed_with_cache(df, text, embedder, cache)[0]
