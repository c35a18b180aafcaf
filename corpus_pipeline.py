"""A pipeline over ``documents``: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's documents. Filters keep rows with all their
columns; the last stage returns the packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm import packing, quality, simhash, toxicity
from citespark.llm.common import id_crc, use_checkpoints

#: Documents with at least this probability of being toxic go, and those below this probability of being good.
TOXIC_SCORE = 0.7
GOOD_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, id_crc(F.col("doc_id")) % 3 != 1)
    return docs.filter(toxicity.toxicity_score(model)(F.col("text")) < TOXIC_SCORE)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, id_crc(F.col("doc_id")) % 5 != 0)
    return docs.filter(quality.quality_score(model)(F.col("text")) >= GOOD_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of rows that repeat it the first."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and offset of each."""
    return packing.pack_documents(docs, packing.byte_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Learned models and fingerprints of hashes are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between them are Parquet tables in the shared checkpoint folder."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}_{name}")
            docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs
