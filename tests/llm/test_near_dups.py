"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from citespark.llm import common, simhash, vector_dups


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def test_components_of_paths_and_random_graphs(spark):
    rng = random.Random(2)
    n = 400
    path = [(i, i + 1) for i in range(150)]
    rng.shuffle(path)
    graph = path + [(rng.randint(200, n - 1), rng.randint(200, n - 1)) for _ in range(120)] + [(5, 5)]
    edges = spark.createDataFrame(graph, "a long, b long").repartition(60)
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    expected = components(n, graph)
    assert got == {x: expected[x] for e in graph for x in e}


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for text in ("", " \n", "One", "a B", "a b c", "É x y z\x85w q", " ".join(rng.choice("abcdef") for _ in range(300))):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        expected = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == expected


def link_components(prints):
    x = np.array(prints, np.uint64)
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if bin(int(x[i] ^ x[j])).count("1") <= 2]
    return components(len(x), pairs)


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 160:  # a dense group in one bucket
        base = rng.choice(sorted(prints)) if rng.random() < 0.5 else centre
        prints.add(base ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64)))
    while len(prints) < 400:
        base = rng.choice(sorted(prints)) if rng.random() < 0.3 else rng.getrandbits(64)
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = [simhash.signed(p) for p in sorted(prints)]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    expected = link_components([p % (1 << 64) for p in prints])
    for bucket in (2, 48, 10_000):
        got = {r["node"]: r["component"] for r in common.connected_components(simhash.links(frame, bucket)).collect()}
        groups = {}
        for p, c in zip(prints, expected):
            groups.setdefault(c, []).append(p)
        for members in groups.values():
            assert {got.get(p, p) for p in members} == {min(members)}


def test_near_duplicates_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    expected = link_components([r["simhash"] % (1 << 64) for r in rows])
    ids = [r["doc_id"] for r in rows]
    assert [r["component_id"] for r in rows] == [ids[c] for c in expected]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted({ids[c] for c in expected})


def test_vector_dups_find_every_link(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    noisy = centres[rng.integers(0, 60, 500)] + 0.22 * rng.standard_normal((500, 32))
    dense = centres[0] + 0.01 * rng.standard_normal((300, 32))
    v = np.concatenate([noisy, dense, dense[:40], rng.standard_normal((300, 32))])
    label = np.concatenate([rng.integers(0, 2, 500), np.zeros(340, int), rng.integers(0, 2, 300)])
    table = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = ((unit @ unit.T) >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    expected = components(len(v), np.argwhere(near).tolist())
    for leaf_rows, block in ((64, 1024), (64, 50)):
        vector_dups.BLOCK_ROWS = block
        try:
            rows = vector_dups.near_duplicates(table, leaf_rows=leaf_rows).orderBy("vec_id").collect()
        finally:
            vector_dups.BLOCK_ROWS = 1024
        assert [r["n_links"] for r in rows] == near.sum(1).tolist()
        assert [r["component_id"] for r in rows] == expected
        assert [r["kept"] for r in rows] == [i == c for i, c in enumerate(expected)]


@pytest.mark.parametrize("mean_cosine", [0.93, 0.9])
def test_vector_dups_of_a_dense_label(spark, mean_cosine):
    """One label around the link distance: a split of it with a narrow band loses links."""
    rng = np.random.default_rng(3)
    n, dim = 4000, 64
    centre = rng.standard_normal(dim)
    noise = np.sqrt((1 / mean_cosine - 1) / dim) * np.linalg.norm(centre)
    v = centre + noise * rng.standard_normal((n, dim))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist(), "label": np.ones(n, int)}))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    rows = vector_dups.near_duplicates(table, leaf_rows=256).orderBy("vec_id").collect()
    assert [r["n_links"] for r in rows] == near.sum(1).tolist()


def test_ids_are_hashed_alike_everywhere(spark):
    row = spark.sql("select 17L id").select(common.id_crc(F.col("id")).alias("c")).first()
    import zlib

    assert row["c"] == zlib.crc32(b"17")
