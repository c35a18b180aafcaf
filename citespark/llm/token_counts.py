"""Token counts through a digest cache.

A row's content is normalised as the tokenizer reads it (NULL is empty; the two
public files need no more) and digested together with the tokenizer's version.
Counts stored under the two digests are joined; only distinct contents without a
stored count are encoded, once each, and appended to the cache. The cache is a
Parquet table partitioned by the version digest: a new tokenizer file or library
never reads the counts of another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from importlib.metadata import version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import checkpoint, map_rows

CACHE_FIELDS = "digest binary, n_tokens long"


class Tokenizer:
    """A tokenizer file: its content travels with the job, so executors need no copy of it."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.content = file.read()
        self.library = "sentencepiece" if path.endswith(".model") else "tokenizers"
        name = json.dumps([self.library, version(self.library), hashlib.sha256(self.content).hexdigest()])
        self.version = hashlib.sha256(name.encode()).hexdigest()

    def counter(self) -> Callable[[list], list]:
        """texts -> numbers of tokens, without begin, end or added special tokens."""
        if self.library == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.content)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer as Library

        model = Library.from_str(self.content.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def content_digest(text):
    """SHA-256 of the normalised content, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def stored_counts(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """Counts in the cache for this tokenizer version; none if the cache is new."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={tokenizer.version}")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.range(0).select(F.lit(b"").alias("digest"), F.col("id").alias("n_tokens"))
    return spark.read.schema(CACHE_FIELDS).parquet(root.toString())


def missing_contents(docs: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """(digest, content): each distinct content without a stored count, once."""
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(content_digest(F.col(text)).alias("digest"), content.alias("content"))
    # copies meet inside the map tasks first, so a text that a third of all rows hold travels once per task
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    return distinct.join(stored.select("digest"), "digest", "left_anti")


def count_contents(contents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of (digest, content)."""

    def make():
        count = tokenizer.counter()
        return lambda digests, texts: [digests, count(texts)]

    return map_rows(contents.select("digest", "content"), CACHE_FIELDS, make, rows=64)


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text, by way of the cache folder ``cache``.

    The folder must be one that all executors share. Counts are written before
    they are joined, so a repeated run encodes nothing again; two writers may
    store the same count twice, and reading removes such repeats. Repeated rows
    and NULL ids stay as they are; an empty text has the tokens that the library
    gives it (none). The text itself is shuffled once, as distinct contents; the
    join back carries digests only.
    """
    spark = docs.sparkSession
    stored = stored_counts(spark, cache, tokenizer)
    fresh = count_contents(missing_contents(docs, stored, text), tokenizer)
    fresh.write.mode("append").parquet(f"{cache}/version={tokenizer.version}")
    known = checkpoint(stored_counts(spark, cache, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    measured = docs.drop(*({"digest", "n_bytes", "n_tokens"} - {text})).withColumns({
        "digest": content_digest(F.col(text)), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
    })
    # both sides are plain exchanges here, so Spark can split a digest that many rows share
    return measured.drop(text).join(known, "digest").drop("digest")
