"""What a step costs grows no faster than its input."""

import time

import numpy as np
from pyspark.sql import functions as F

from citespark.functions import identifiers as ids
from citespark.operators import bibliography as bb
from citespark.operators import pq_index, ranking
from citespark.operators import similarity as sim
from citespark.operators import sync as sy
from citespark.plans import suggest
from citespark.sources import feeds


def test_long_bibtex_values_cost_by_their_length(spark):
    word = "{Gr\\\"oße} of things, "
    entry = "@article{k,\n  title = {" + word * 400 + "},\n  journal = \"" + "plain " * 2000 + "\",\n  doi = 10.1/x\n}"
    entries = spark.range(0, 200, 1, 8).select("id", F.concat(F.lit(entry), F.col("id").cast("string")).alias("t"))
    start = time.perf_counter()
    row = feeds.parse_bibtex(entries, "t").agg(
        F.min(F.length("title")).alias("shortest"), F.max(F.length("journal")).alias("longest"), F.count("doi").alias("n")
    ).first()
    assert (row["shortest"], row["longest"], row["n"]) == (len(word * 400) - 800 - 1, len("plain " * 2000) - 1, 200)
    assert time.perf_counter() - start < 30


def test_requests_of_equal_order_are_numbered_by_paper(spark):
    rows = [(1, 200005 - 100000 * i, 200005 + 100000 * (i > 1)) for i in range(4)]
    requests = spark.createDataFrame(rows, "document_id long, paper_id long, seq long").coalesce(1)
    none = spark.createDataFrame([], "document_id long, paper_id long, position int")
    got = bb.assign_positions(requests, none, "seq").collect()
    assert [r["position"] for r in sorted(got, key=lambda r: (r["seq"], r["paper_id"]))] == [0, 1, 2, 3]


def test_small_blocks_do_not_multiply_the_rows(spark):
    """2 queries and 2 chunks a block: parts of queries grow with the table, their number does not."""
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(900, 8)).tolist())]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    chunks = queries.withColumnRenamed("query_id", "chunk_id")
    options = {"min_similarity": 0.3, "broadcast_queries": 0, "n_cells": 4, "block_rows": 2, "query_block_rows": 2}
    start = time.perf_counter()
    got = sim.similarity_join(queries, chunks, k=5, **options)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit @ unit.T, 12), axis=1, kind="stable")[:, :5]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [
        (q, n + 1, c) for q in range(900) for n, c in enumerate(want[q].tolist())
    ]
    above = {r.query_id: r.above for r in sim.count_above(queries, chunks, **options).collect()}
    assert above == dict(enumerate((unit @ unit.T > 0.3).sum(axis=1).tolist()))
    assert time.perf_counter() - start < 45


def test_pairs_next_to_the_threshold_are_decided_in_double(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    edge = np.arccos(0.6)
    near = [edge - 1e-9, edge + 1e-9, edge - 1e-7, edge + 1e-7]
    queries = spark.createDataFrame([(0, turn(0.0)), (1, turn(0.0))], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, turn(a)) for i, a in enumerate(near)], "chunk_id long, embedding array<double>")
    for physical in ({}, {"broadcast_queries": 1, "n_cells": 2}):
        got = sim.similarity_join(queries, chunks, k=4, min_similarity=0.6, **physical)
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [(0, 1, 2), (0, 2, 0), (1, 1, 2), (1, 2, 0)]
        above = sim.count_above(queries, chunks, min_similarity=0.6, **physical)
        assert sorted((r.query_id, r.above) for r in above.collect()) == [(0, 2), (1, 2)]


def test_one_bucket_with_all_rows_stays_in_bounds(spark):
    """All rows share one bucket of every table; its pairs are products in a task, not rows of a join."""
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(4000, 16)) + 0.5).tolist())]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    chunks = queries.withColumnRenamed("query_id", "chunk_id")
    start = time.perf_counter()
    near = sim.similarity_join_lsh(queries, chunks, k=5, min_similarity=0.2, bucket_length=100.0)
    exact = sim.similarity_join(queries, chunks, k=5, min_similarity=0.2)
    assert sim.recall(exact, near, ["query_id", "chunk_id"]).first()["recall"] == 1.0
    assert time.perf_counter() - start < 40


def test_rows_without_a_common_bucket_do_not_meet(spark):
    rows = [(i, [1.0, 0.05 * i]) for i in range(12)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    chunks = queries.withColumnRenamed("query_id", "chunk_id")
    near = sim.similarity_join_lsh(queries, chunks, k=12, min_similarity=0.5, bucket_length=0.01, tables=1)
    pairs = {(r.query_id, r.chunk_id) for r in near.collect()}
    assert {(i, i) for i in range(12)} <= pairs and len(pairs) < 144


def test_only_selected_collections_are_grouped(spark):
    selected = spark.createDataFrame([(u, 0, "K", None) for u in range(20)], "user_id long, position int, collection_key string, library_id string")
    collections = spark.range(20).selectExpr("id AS user_id", "explode(array('K', 'L', 'M')) AS collection_key").selectExpr(
        "*", "explode(array(1, 2)) AS library_order", "concat('groups/', user_id) AS library_id"
    )
    for step in (sy.locate_collections, sy.migrate_collections):
        out = step(selected, collections)
        assert sorted((r.user_id, r.library_id) for r in out.collect()) == [(u, f"groups/{u}") for u in range(20)]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        grouped = plan[next(plan.index(f) for f in ("max_by", "min_by") if f in plan):]
        assert "LeftSemi" in grouped


def test_texts_are_searched_once_per_pattern(spark):
    """All patterns together take little more than one search of the texts for each."""
    words = "the 10 papers of 2021, vol. 3, cite no identifier; "
    texts = spark.range(0, 64, 1, 8).select("id", F.concat(F.repeat(F.lit(words), 12000), F.col("id").cast("string")).alias("x")).cache()
    texts.count()
    once = [F.sum(F.size(F.regexp_extract_all("x", F.lit(p.replace(r"\b", ids.ASCII_EDGE)), F.lit(0)))) for _, p in ids.HIGHLIGHT_PATTERNS]

    def seconds(df):
        start = time.perf_counter()
        df.collect()
        return time.perf_counter() - start

    plain = min(seconds(texts.select(*once)) for _ in range(2))
    found = min(seconds(ids.find_all_identifiers(texts, "id", "x")) for _ in range(2))
    texts.unpersist()
    assert found < 2 * plain, (found, plain)


def test_all_cells_of_a_query_are_ranked_in_one_task(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(300, 16)).tolist())], "chunk_id long, embedding array<float>")
    model = pq_index.train(vectors, n_cells=6)
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    found = pq_index.search(queries, pq_index.encode(vectors, model), vectors, model, k=1, n_probe=6, rerank=20)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(i, i) for i in range(300)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # grouped by part and qpart, not by cell as well
    assert "FlatMapCoGroupsInArrow 2, 2," in plan


def test_centres_cost_by_their_rows(spark):
    """The length of a vector is worked out once, not at each of its numbers."""
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(8000, 64)).tolist())] + [(8000, [0.0] * 64)]
    vectors = spark.createDataFrame(rows, "key long, vec array<float>").coalesce(1)
    start = time.perf_counter()
    centres = sim.train_centres(vectors, "vec", 4, max_iter=2)
    assert centres.shape == (4, 64) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert time.perf_counter() - start < 14


def test_centres_of_an_exact_join_are_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    fit = sim.train_centres
    monkeypatch.setattr(sim, "TRAIN_ROWS", 100)
    monkeypatch.setattr(sim, "train_centres", lambda df, *rest: seen.append(df.count()) or fit(df, *rest))
    rng = np.random.default_rng(10)
    unit = rng.normal(size=(600, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(unit.tolist())], "query_id long, embedding array<double>")
    got = sim.similarity_join(
        queries, queries.withColumnRenamed("query_id", "chunk_id"), k=3, min_similarity=0.2, broadcast_queries=10, n_cells=4
    )
    want = np.argsort(-np.round(unit @ unit.T, 12), axis=1, kind="stable")[:, :3]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [
        (q, n + 1, c) for q in range(600) for n, c in enumerate(want[q].tolist())
    ]
    assert 40 < seen[0] < 200


def test_parts_of_queries_lie_in_tasks_of_their_own(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(960, 8)).tolist())], "key long, vec array<double>")
    rows = rows.withColumn("grp", F.lit(None).cast("string"))
    centres = sim.train_centres(rows, "vec", 2)
    indexed = sim.assign_cells(rows, "key", "vec", centres)
    index = sim.build_cell_index(indexed, centres)
    found = sim._block_join(
        sim._placed(rows, index, 0.2, None), indexed, sim._result_schema(rows, rows), sim._top_k_maker(1, 0.2), None, 20
    )
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("query_key").alias("n")).collect()
    # parts are stretches of a hash order, so a few differ in size
    assert len(tasks) == sim.QUERY_PARTS and sum(t.n for t in tasks) == 960


def test_scores_are_worked_out_once(spark):
    row = (1, 2, 3, 0.9, 2020, 50, ["a"], ["b"], ["a"], ["b"])
    schema = "query_id long, paper_id long, chunk_id long, similarity double, year int, citation_count int, " + ", ".join(
        f"{c} array<string>" for c in ranking.WORD_COLUMNS
    )
    ranked = ranking.rank_candidates(spark.createDataFrame([row], schema), as_of_year=2025, min_relevance=0.4)
    assert [(r.position, r.context_score) for r in ranked.collect()] == [(1, 0.62)]
    # one for titles and one for abstracts; the filter on the score had two more
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 2


def test_words_are_split_for_papers_with_chunks(spark):
    papers = spark.range(40).selectExpr(
        "id AS paper_id", "concat('t', id) AS title", "'x y' AS abstract", "2020 AS year", "50 AS citation_count",
        "true AS is_processed",
    )
    chunks = spark.range(6).selectExpr("id AS chunk_id", "id % 2 AS paper_id", "array(1D, 0.1D * id) AS embedding")
    requests = chunks.selectExpr("chunk_id AS query_id", "embedding", "'t1' AS previous_sentence", "'x' AS paragraph")
    found = suggest.candidate_chunks(requests, chunks, papers, min_similarity=0.2)
    assert found.count() == 36
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_vectors_travel_once_a_range_not_once_a_pair(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 16))
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "chunk_id long, embedding array<double>")
    model = pq_index.train(vectors, n_cells=6)
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    found = pq_index.search(queries, pq_index.encode(vectors, model), vectors, model, k=5, n_probe=6, rerank=400)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit @ unit.T, 12), axis=1, kind="stable")[:, :5]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect()) == [(q, n + 1, c) for q in range(400) for n, c in enumerate(want[q].tolist())]


def test_entries_that_are_equal_are_taken_by_key(spark, monkeypatch):
    rng = np.random.default_rng(11)
    one, others = rng.normal(size=16), rng.normal(size=(200, 16))
    rows = list(enumerate([one.tolist()] * 6000 + others.tolist()))
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    model = pq_index.train(vectors, n_cells=4)
    entries = pq_index.encode(vectors, model)
    queries = vectors.filter("chunk_id % 1000 = 0").withColumnRenamed("chunk_id", "query_id")
    for waiting in (None, 10):
        if waiting:
            monkeypatch.setattr(pq_index, "WAITING_ROWS", waiting, raising=False)
        found = pq_index.search(queries, entries, vectors, model, k=5, n_probe=4, rerank=5).collect()
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found if r.query_id < 6000) == [(q, n + 1, n) for q in range(0, 6000, 1000) for n in range(5)]
