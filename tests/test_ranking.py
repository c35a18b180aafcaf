"""Scores, ranking rules, and similarity joins against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.functions import scoring, vectors
from citespark.operators import ranking, timeline
from citespark.operators import similarity as sim


def value(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


@pytest.mark.parametrize("age,score", [(0, 1.0), (2, 1.0), (3, 0.8), (5, 0.8), (6, 0.6), (10, 0.6), (11, 0.78), (35, 0.3), (36, 0.3), (50, 0.3)])
def test_recency(spark, age, score):
    assert value(spark, scoring.recency_score(F.lit(2025 - age), 2025)) == pytest.approx(score)


def test_recency_without_year(spark):
    assert value(spark, scoring.recency_score(F.lit(None).cast("int"), 2025)) == 0.3


@pytest.mark.parametrize("cites,rank,score", [(500, "A+", 1.0), (50, "B", 0.7999999999999999), (10, "C", 0.5), (None, None, 0.5), (101, None, 0.8)])
def test_quality(spark, cites, rank, score):
    q = scoring.quality_score(F.lit(cites).cast("int"), F.lit(rank).cast("string"))
    assert value(spark, q) == score


def test_context_caps(spark):
    words = "a b c d e f g h i j k l m"
    full = scoring.context_score(F.lit(words), F.lit(words), F.lit(words), F.lit(words))
    assert value(spark, full) == pytest.approx(1.0)
    none = scoring.context_score(F.lit(None).cast("string"), F.lit(""), F.lit(words), F.lit(words))
    assert value(spark, none) == 0.5
    assert value(spark, scoring.context_score(F.lit("Größe x"), F.lit(""), F.lit("GRÖSSE größe"), F.lit(""))) == pytest.approx(0.6)


CAND = "query_id int, chunk_id int, paper_id string, title string, abstract string, year int, citation_count int, venue_rank string, similarity double, previous_sentence string, paragraph string"


def test_relevance_of_a_good_candidate(spark):
    row = (1, 1, "p", "Machine Learning for NLP", "about", 2023, 150, "A", 0.9, "NLP has evolved significantly", "")
    got = ranking.score_candidates(spark.createDataFrame([row], CAND), 2025).collect()[0]
    assert 0.5 < got.relevance <= 1 and got.band == "medium"
    assert got.relevance == pytest.approx(0.9 * 0.4 + 0.6 * 0.25 + 1.0 * 0.15 + 0.1 + 0.05)


def test_filter_before_cap_and_two_orders(spark):
    rows = [
        (1, 1, "p", "t", "", 1900, 0, None, 0.54, "", ""),  # most similar, scores too low
        (1, 2, "p", "t", "", 2025, 200, None, 0.53, "", ""),
        (1, 3, "p", "t", "", 2025, 200, None, 0.52, "", ""),
        (1, 4, "p", "t", "", 2025, 200, None, 0.51, "", ""),
        (1, 5, "q", "t", "", 2025, 0, None, 0.50, "", ""),
    ]
    out = ranking.rank_candidates(spark.createDataFrame(rows, CAND), as_of_year=2025).orderBy("position").collect()
    assert [r.chunk_id for r in out] == [2, 3, 5]


def test_dimension_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<float>")
    good, bad = vectors.split_by_dimension(df, "v", 2)
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r.reason for r in bad.collect()) == ["expected 2 dimensions, got 1", "expected 2 dimensions, got no vector"]
    with pytest.raises(Exception, match="expected 2 dimensions, got 1"):
        df.filter("id = 2").select(vectors.require_dimension(F.col("v"), 2)).collect()


def brute(queries, chunks, k, t, exclude=None):
    out = []
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    qi, qv = zip(*queries, strict=True)
    ci, cv = zip(*chunks, strict=True)
    s = np.round(unit(np.array(qv, float)) @ unit(np.array(cv, float)).T, 12)
    for a, q in enumerate(qi):
        ranked = sorted((-s[a, b], c) for b, c in enumerate(ci) if s[a, b] > t and not (exclude and q == c))
        out += [(q, c, r + 1) for r, (_, c) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def skewed(spark):
    """300 chunks of which a third are copies of one vector."""
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(200, 8)), 3).tolist()
    chunks = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(100)]
    queries = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(40, 8)), 3).tolist())] + [(77, base[0])]
    cdf = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>").repartition(6)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    return queries, chunks, qdf, cdf


@pytest.mark.parametrize("physical", [{}, {"broadcast_queries": 3, "n_cells": 5, "block_rows": 30, "query_block_rows": 10}])
@pytest.mark.parametrize("threshold", [0.3, -1.0])
def test_similarity_join_is_exact(skewed, physical, threshold):
    queries, chunks, qdf, cdf = skewed
    got = sim.similarity_join(qdf, cdf, k=7, min_similarity=threshold, **physical).collect()
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in got) == brute(queries, chunks, 7, threshold)


def test_similarity_join_string_keys_and_self(spark):
    rows = [(f"p{i}", [float(i), 1.0, float(i % 3)]) for i in range(12)] + [("bad", [1.0]), ("none", None), ("zero", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "paper_id string, embedding array<float>")
    want = [(q, c, r) for q, c, r in brute(rows[:12], rows[:12], 3, 0.5, exclude=True)]
    for physical in ({}, {"broadcast_queries": 1, "n_cells": 3, "block_rows": 4, "query_block_rows": 5}):
        got = sim.paper_neighbours(df.filter("paper_id <> 'bad'"), df.filter("paper_id LIKE 'p%'"), limit=3, **physical)
        assert sorted((r.paper_id, r.neighbour_id, r["rank"]) for r in got.collect()) == want


@pytest.mark.parametrize("physical", [{}, {"broadcast_queries": 3, "n_cells": 5, "block_rows": 30, "query_block_rows": 10}])
@pytest.mark.parametrize("threshold", [0.3, -1.0])
def test_count_above_is_exact(skewed, physical, threshold):
    queries, chunks, qdf, cdf = skewed
    want = Counter(q for q, _, _ in brute(queries, chunks, len(chunks), threshold))
    got = {r.query_id: r.above for r in sim.count_above(qdf, cdf, min_similarity=threshold, **physical).collect()}
    assert got == dict(want)
    assert sim.count_above(qdf.limit(0), cdf, min_similarity=threshold).collect() == []


def test_running_number_of_sparse_order(spark):
    """Borders follow the rows, so values far apart do not make a bucket each, and a hot key is cut."""
    rows = [("hot", i * i * 1000) for i in range(700)] + [("hot", None), ("cold", 5), ("cold", -3)]
    df = spark.createDataFrame(rows, "k string, v long")
    buckets = timeline.ranked_buckets(df, "v", size=100).groupBy("_bucket").count().collect()
    assert 7 <= len(buckets) <= 9 and max(r["count"] for r in buckets) < 200
    plain = {(r.k, r.v): i for k in ("hot", "cold") for i, r in enumerate(sorted((r for r in df.collect() if r.k == k), key=lambda r: (r.v is not None, r.v or 0)), 1)}
    for size in (50, 100_000):
        place = timeline.ranked_buckets(df, "v", "place", size)
        got = timeline.running_number(place, ["k"], ["v"], F.col("place"), "n")
        assert {(r.k, r.v): r.n for r in got.collect()} == plain


def test_no_queries(skewed):
    _, _, qdf, cdf = skewed
    assert sim.similarity_join(qdf.limit(0), cdf, k=3, min_similarity=0.1).collect() == []


def test_cell_index(skewed):
    queries, chunks, qdf, cdf = skewed
    centres = sim.train_centres(cdf, "embedding", 6)
    indexed = sim.assign_cells(cdf, "chunk_id", "embedding", centres)
    index = sim.build_cell_index(indexed, centres, block_rows=25)
    assert index.blocks.max() >= 4  # the cell of the copies is split
    everything = sim.similarity_join_ivf(qdf, indexed, index, k=7, min_similarity=0.3, n_probe=6)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in everything.collect()) == brute(queries, chunks, 7, 0.3)
    few = sim.similarity_join_ivf(qdf, indexed, index, k=7, min_similarity=0.3, n_probe=2)
    exact = sim.similarity_join(qdf, cdf, k=7, min_similarity=0.3)
    assert sim.recall(exact, few, ["query_id", "chunk_id"]).collect()[0].recall > 0.5


def test_lsh_recall(skewed):
    _, _, qdf, cdf = skewed
    near = sim.similarity_join_lsh(qdf, cdf, k=7, min_similarity=0.6)
    exact = sim.similarity_join(qdf, cdf, k=7, min_similarity=0.6)
    assert sim.recall(exact, near, ["query_id", "chunk_id"]).collect()[0].recall > 0.5
