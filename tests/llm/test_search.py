"""Nearest neighbours: recall against brute force, exact scores, ties, copies and uneven lengths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citespark.llm import ann


def brute(v, ids, queries, k):
    out = {}
    for q in queries:
        scores = (v * v[ids.index(q)]).sum(1)
        order = sorted((-scores[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def frame(spark, v, ids):
    return spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies", "two_functions"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 3000, 24
    v = rng.standard_normal((n, dim))
    if kind != "lengths":
        v /= np.linalg.norm(v, axis=1)[:, None]
    else:
        v *= rng.uniform(0.5, 2.0, n)[:, None]
    if kind == "copies":
        v[:1000] = v[0]
    ids = list(range(n))
    table = frame(spark, v, ids)
    options = {"cell_rows": 40, "probes": 20} if kind == "two_functions" else {}
    rows = ann.nearest_neighbours(table, table.filter("vec_id % 20 = 0"), k=20, **options).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute(v, ids, range(0, n, 20), 20)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected]
    assert np.mean(hits) / 20 >= 0.9
    for q, got in found.items():
        assert len(got) == 20 and q not in {i for i, _ in got}
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        for i, score in got:
            assert abs(score - float(np.dot(v[i], v[q]))) < 1e-12
    if kind == "copies":
        assert [i for i, _ in found[20]] == [i for i in range(21) if i != 20]


@pytest.mark.parametrize("kind,n,options", [
    ("outlier", 6000, {}), ("log-normal", 6000, {}), ("log-normal", 6000, {"cell_rows": 300}), ("far apart", 6000, {"probes": 1}),
])
def test_recall_with_uneven_lengths(spark, kind, n, options):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "outlier":
        v[7] *= 200
    elif kind == "log-normal":
        v *= np.exp(rng.standard_normal(n))[:, None]
    else:  # all on one axis but a few, whose cells are nearly empty
        v[200:] = np.eye(64)[0] + 1e-3 * v[200:]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist()}))
    asked = table.filter("vec_id < 200 AND vec_id % 2 = 0")
    found = {}
    for r in ann.nearest_neighbours(table, asked, k=20, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 100 and {len(f) for f in found.values()} == {20}
    if kind != "far apart":
        expected = brute(v, list(range(n)), range(0, 200, 2), 20)
        assert np.mean([len(found[q] & {i for i, _ in expected[q]}) for q in expected]) / 20 >= 0.95


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_hashing_decides_rows_of_small_tables(spark):
    rng = np.random.default_rng(21)
    v = rng.standard_normal((2000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = frame(spark, v, list(range(2000)))
    asked = table.filter("vec_id % 20 = 0")
    expected = {q: [i for i, _ in hits] for q, hits in brute(v, list(range(2000)), range(0, 2000, 20), 20).items()}
    share = lambda got: np.mean([len(set(got[q]) & set(expected[q])) for q in expected]) / 20
    assert 0.95 <= share(found_by(ann.nearest_neighbours(table, asked, k=20).collect()))
    assert share(found_by(ann.nearest_neighbours(table, asked, k=20, probes=2).collect())) < 0.9
    assert found_by(ann.nearest_neighbours(table, asked, k=20, whole_rows=2000).collect()) == expected


def test_probes_are_the_best_combinations():
    x = ann.directions(np.random.default_rng(3).standard_normal((5, 8)), 8)
    signs = ann.rotations(8, 2, 2)
    got = ann.probes_of(x, signs, 3)
    assert got.shape == (5, 2, 9) and (got[:, :, 0] == ann.cells_of(x, signs)).all()
    for t in range(2):
        first, second = (np.stack([y := ann.rotate(x, s), -y], axis=2).reshape(5, 16) for s in signs[t])
        sums = (first[:, :, None] + second[:, None, :]).reshape(5, 256)
        for r in range(5):
            assert set(got[r, t]) == set(np.argsort(-sums[r], kind="stable")[:9])


def test_fewer_candidates_than_asked_for(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((6, 8))
    table = frame(spark, v, list(range(6)))
    rows = ann.nearest_neighbours(table, table.filter("vec_id = 0"), k=20, probes=32).collect()
    assert sorted(r["vec_id"] for r in rows) == [1, 2, 3, 4, 5]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 16))
    y = ann.rotate(x, ann.rotations(16, 1, 1)[0, 0])
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


def test_large_groups_are_split(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([np.tile(rng.standard_normal(8), (300, 1)) + 1e-3 * rng.standard_normal((300, 8)), rng.standard_normal((100, 8))])
    table = frame(spark, v, list(range(400)))
    queries = table.filter(F.col("vec_id") % 20 == 0)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)
    small = ann.nearest_neighbours(table, queries, k=5, block_rows=32).collect()
    assert key(small) == key(ann.nearest_neighbours(table, queries, k=5).collect())


def test_a_visit_is_no_row(spark, monkeypatch):
    """A query visits 8 x 576 cells; no table that is written has more rows than there are vectors."""
    rng = np.random.default_rng(33)
    v = rng.standard_normal((1500, 16))
    table = frame(spark, v, list(range(1500)))
    written, write = [], ann.checkpoint

    def counted(df):
        df = write(df)
        written.append(df.count())
        return df

    monkeypatch.setattr(ann, "checkpoint", counted)
    got = found_by(ann.nearest_neighbours(table, table.filter("vec_id % 20 = 0"), k=20, cell_rows=20).collect())
    assert len(got) == 75 and {len(g) for g in got.values()} == {20}
    assert max(written) <= 1500
