"""The stored approximate index: recall against brute force, updates, splits, awkward rows."""

import numpy as np
import pytest

from citespark.operators import pq_index as pq

DIM, PARTS = 32, 8


def clustered(n, seed=1, dim=DIM):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(40, size=n)] + 0.6 * rng.normal(size=(n, dim))


def frame(spark, x, start=0):
    rows = [(start + i, [float(v) for v in row], "z", "z") for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, key string, cell string")


def brute(queries, x, ids, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(x).T, 12)
    return {(q, ids[i]) for q, row in enumerate(sims) for i in sorted(range(len(ids)), key=lambda i: (-row[i], ids[i]))[:k]}


def recall(found, want):
    got = {(r["query_id"], r["chunk_id"]) for r in found.collect()}
    return len(got & want) / len(want)


@pytest.fixture(scope="module")
def built(spark):
    x = clustered(3000)
    table = frame(spark, x).repartition(4).cache()
    model = pq.train(table, n_cells=24, n_parts=PARTS)
    entries = pq.encode(table, model).cache()
    queries = clustered(60, seed=2)
    asked = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(queries)], "query_id long, embedding array<double>")
    return x, table, model, entries, queries, asked


def test_recall_and_exact_scores(built):
    x, table, model, entries, queries, asked = built
    found = pq.search(asked, entries, table, model, k=10, n_probe=6, rerank=80).cache()
    assert recall(found, brute(queries, x, list(range(len(x))), 10)) >= 0.9
    for row in found.collect()[:50]:
        a, b = queries[row["query_id"]], x[row["chunk_id"]]
        assert abs(row["similarity"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9
    # fewer cells are met, and one part's byte is all that an entry keeps of it
    assert entries.first()["codes"].__len__() == PARTS
    assert recall(pq.search(asked, entries, table, model, k=10, n_probe=1, rerank=80), brute(queries, x, list(range(len(x))), 10)) < 1.0


def test_blocks_do_not_change_results(built, monkeypatch):
    _, table, model, entries, _, asked = built
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(pq.search(asked, entries, table, model, k=5, n_probe=4, rerank=50))
    monkeypatch.setattr(pq, "BLOCK_ROWS", 40)
    monkeypatch.setattr(pq, "QUERY_ROWS", 7)
    assert key(pq.search(asked, entries, table, model, k=5, n_probe=4, rerank=50)) == whole


def test_insert_delete_and_change(spark, built):
    x, table, model, entries, queries, asked = built
    fresh = clustered(300, seed=5)
    moved = clustered(50, seed=6)
    ids = list(range(len(x) + len(fresh)))
    state = np.vstack([x, fresh])
    state[100:150] = moved
    gone = set(range(0, 3000, 9))
    log = entries.unionByName(pq.encode(frame(spark, fresh, 3000), model, 1)).unionByName(pq.encode(frame(spark, moved, 100), model, 2))
    log = log.unionByName(pq.deletions(spark.createDataFrame([(i,) for i in gone], "chunk_id long"), 3))
    left = [i for i in ids if i not in gone]
    assert sorted(r["key"] for r in pq.live(log).collect()) == left
    now = frame(spark, state)
    # the new rows come from clusters that the model was not fitted on, so more cells are met
    found = pq.search(asked, log, now, model, k=10, n_probe=12, rerank=120)
    assert recall(found, brute(queries, state[left], left, 10)) >= 0.9
    again = log.unionByName(pq.encode(now.filter("chunk_id = 9"), model, 4))
    assert pq.live(again).filter("key = 9").count() == 1


def test_split_of_large_cells(built):
    x, table, model, entries, queries, asked = built
    before = {r["cell"]: r["count"] for r in pq.live(entries).groupBy("cell").count().collect()}
    largest = max(before.values())
    added, split = pq.split_cells(entries, table, model, largest - 1, 1)
    assert len(split.centres) == len(model.centres) + 1 and (split.words == model.words).all()
    touched = added.count()
    assert touched == largest  # the rows of that cell alone are coded again
    log = entries.unionByName(added)
    after = {r["cell"]: r["count"] for r in pq.live(log).groupBy("cell").count().collect()}
    assert sum(after.values()) == len(x) and max(after.values()) <= largest
    assert recall(pq.search(asked, log, table, split, k=10, n_probe=6, rerank=80), brute(queries, x, list(range(len(x))), 10)) >= 0.9
    none, same = pq.split_cells(entries, table, model, largest, 1)
    assert none.count() == 0 and same is model


def test_model_is_stored(spark, built, tmp_path):
    _, _, model, _, _, _ = built
    pq.save_model(spark, model, str(tmp_path))
    again = pq.load_model(spark, str(tmp_path))
    assert np.array_equal(again.centres, model.centres) and np.array_equal(again.words, model.words)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [0.0, 2.0]), (7, [-1.0, 0.1])]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    model = pq.train(table, n_cells=4, n_parts=1)
    entries = pq.encode(table, model)
    assert sorted(r["key"] for r in entries.collect()) == [1, 2, 3, 6, 7]
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    found = pq.search(asked, entries, table, model, k=2, min_similarity=0.5, n_probe=9)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2)]
    assert pq.search(asked, entries.limit(0), table, model, k=2).collect() == []
    assert pq.search(asked.limit(0), entries, table, model, k=2).collect() == []
    with pytest.raises(ValueError):
        pq.train(table.limit(0))
    with pytest.raises(Exception):
        pq.encode(spark.createDataFrame([(8, [1.0])], "chunk_id long, embedding array<double>"), model).collect()
