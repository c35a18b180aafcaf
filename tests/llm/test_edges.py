"""Every operator on awkward rows and on empty tables, and its defined result there."""

import math
import os
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import TEXTS, edge_docs, edge_labels  # noqa: E402

from citespark.llm import ann, bpe, html_text, licenses, packing, quality, simhash, token_counts, toxicity, vector_dups  # noqa: E402

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def scored(docs, labels, module, fit, score):
    return docs.select("doc_id", score(fit(docs, labels, F.lit(True)))(F.col("text")).alias("score"))


def row_operators(docs, labels, tmp):
    tokenizer = token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    return {
        "licenses": lambda: licenses.scan_licenses(docs),
        "toxicity": lambda: scored(docs, labels, toxicity, toxicity.fit_toxicity, toxicity.toxicity_score),
        "quality": lambda: scored(docs, labels, quality, quality.fit_quality, quality.quality_score),
        "simhash": lambda: simhash.near_duplicates(docs),
        "round_trip": lambda: bpe.round_trip(docs, BYTE_BPE),
        "encode": lambda: bpe.decode_ids(bpe.encode_texts(docs, BYTE_BPE), BYTE_BPE),
        "token_counts": lambda: token_counts.token_counts(docs, tokenizer, f"{tmp}/cache"),
        "html": lambda: html_text.extract_main_text(docs, "doc_id", "text", "main"),
    }


NAMES = list(row_operators(None, None, ""))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, tmp_path, name):
    docs, labels = edge_docs(spark), edge_labels(spark)
    rows = row_operators(docs, labels, tmp_path)[name]().collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((i for i, _ in TEXTS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    docs, labels = edge_docs(spark).limit(0), edge_labels(spark).limit(0)
    assert row_operators(docs, labels, tmp_path)[name]().collect() == []
    assert row_operators(edge_docs(spark), labels, tmp_path)[name]().count() == len(TEXTS)


def test_null_text_is_empty_text(spark):
    docs = edge_docs(spark)
    scan = {r["doc_id"]: r["scan"] for r in licenses.scan_licenses(docs).filter("doc_id in (2, 3)").collect()}
    assert scan[2] == scan[3] and scan[2]["n_words"] == 0 and scan[2]["first_word"] is None
    coded = {r["doc_id"]: r["coded"] for r in bpe.round_trip(docs, BYTE_BPE).filter("doc_id in (2, 3)").collect()}
    assert coded[2] == coded[3] and coded[2]["n_tokens"] == 0
    marks = {r["doc_id"]: r["simhash"] for r in simhash.fingerprints(docs).filter("doc_id in (2, 3, 7)").collect()}
    assert marks == {2: 0, 3: 0, 7: 0}


def test_packing_edges(spark):
    docs = edge_docs(spark)
    tokenizer = packing.byte_tokenizer(BYTE_BPE)
    rows = packing.pack_documents(docs, tokenizer).toPandas()
    assert len(rows[rows["start"] == 0]) == len(TEXTS)
    assert rows.loc[rows["doc_id"] == 2, "length"].tolist() == [1]
    assert packing.pack_documents(docs.limit(0), tokenizer).count() == 0


def test_keep_one_edges(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 2, 3, 7 and the empty row without id share fingerprint 0; 5 and both rows 6 are one text
    assert sorted(i for i in ids if i in (2, 3, 7)) == [2]
    assert sorted(i for i in ids if i in (5, 6)) == [5]
    assert simhash.keep_one(docs.limit(0)).count() == 0


VECTORS = [
    (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0),
    (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 0.0], 1), (10, [1.0, 0.0], None),
    (11, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (12, [1e300, 0.0], 0), (13, [1.0], 0), (14, [], 0),
]


def edge_vectors(spark):
    rows = [(i, v, lab, "z", "z") for i, v, lab in VECTORS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long, `class` string".replace("n long", "n string"))


def test_vector_dups_edges(spark):
    rows = vector_dups.near_duplicates(edge_vectors(spark)).collect()
    assert len(rows) == len(VECTORS)
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in rows}
    # label 0, direction (1, 0): ids 1, 2, 2, 3, 12 and a row without id
    assert {(1, 5, 1), (2, 5, 1), (3, 5, 1), (12, 5, 1), (None, 5, 1)} <= got
    assert {(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 13, 14)} <= got
    assert vector_dups.near_duplicates(edge_vectors(spark).limit(0)).count() == 0


def test_nearest_edges(spark):
    table = edge_vectors(spark).filter("vec_id is null or vec_id < 12 or vec_id > 12")
    found = ann.nearest_neighbours(table, table.filter("vec_id in (1, 4, 5)"), k=3).collect()
    assert {r["query_id"] for r in found} == {1}
    best = sorted((r["rank"], r["vec_id"], r["score"]) for r in found)
    assert best == [(1, 3, 2.0), (2, 2, 1.0), (3, 9, 1.0)]
    assert ann.nearest_neighbours(table.limit(0), table, k=3).count() == 0
    assert not math.isnan(best[0][2])
