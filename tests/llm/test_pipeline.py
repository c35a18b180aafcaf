"""The pipeline's stages against their operators and brute force."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from citespark.llm import packing, quality, simhash, toxicity
from citespark.llm.common import id_crc

NAMES = ["toxicity", "quality", "simhash_near_dedup", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input, and the result of the last."""
    folder, sf_dir = tmp_path_factory.mktemp("stages"), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{number}")
        out.append(spark.read.parquet(f"{folder}/{number}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == NAMES
    assert all(s.columns == stages[0].columns for s in stages[:4])


def test_filters_keep_what_their_model_keeps(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit_toxicity(stages[0], labels, id_crc(F.col("doc_id")) % 3 != 1)
    rows = stages[0].select("doc_id", "text").collect()
    scores = model.score([r["text"] or "" for r in rows])
    assert ids(stages[1]) == {r["doc_id"] for r, s in zip(rows, scores) if s < 0.7}
    model = quality.fit_quality(stages[1], labels, id_crc(F.col("doc_id")) % 5 != 0)
    rows = stages[1].select("doc_id", "text").collect()
    scores = model.score([r["text"] or "" for r in rows])
    assert ids(stages[2]) == {r["doc_id"] for r, s in zip(rows, scores) if s >= 0.3}
    assert 0.5 * len(ids(stages[0])) < len(ids(stages[2])) < len(ids(stages[0]))


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"] or "")) for r in stages[2].collect())
    group = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, p in rows:
            least = min(group[e] for e, q in rows if bin(p ^ q).count("1") <= 2)
            changed |= least < group[d]
            group[d] = min(group[d], least)
    assert ids(stages[3]) == set(group.values())


def test_all_tokens_are_packed(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    rows = stages[4].toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == expected
    assert rows.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_edges(spark, tmp_path):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from fixtures import TEXTS, edge_docs, edge_labels

    edge_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for docs, rows in ((edge_docs(spark), len(TEXTS)), (edge_docs(spark).limit(0), 0)):
        for name, stage in pipeline.STAGES:
            count = stage(spark, docs, str(tmp_path)).count()
            assert (count <= rows if name != "packing" else count >= rows), name


def test_registered(spark):
    queries = entry.queries()
    assert queries["pipeline"] is pipeline.run
    assert {n.split("_")[0] for n in queries if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
