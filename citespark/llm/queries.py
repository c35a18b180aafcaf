"""Queries over the driver's tables: every operator with its production parameters on its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm import (
    ann, bpe, html_text, licenses, merkle, packing, phrases, quality, simhash, token_counts, toxicity, vector_dups, warc,
)
from citespark.llm.common import id_crc, use_checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", *(f"scan.{f}" for f in licenses.FIELDS))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc(F.col("doc_id")) % 3 == 1
    score = toxicity.toxicity_score(toxicity.fit_toxicity(docs, labels, ~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    score = quality.quality_score(quality.fit_quality(docs, labels, ~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op5_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE["op5_vector_dups"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, c) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.c
), component AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, k.component_id,
       e.vec_id = k.component_id AS kept
FROM embeddings e JOIN component k ON k.vec_id = e.vec_id
"""


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty: every distinct content of the table is encoded in this run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    use_checkpoints(spark)
    cache = f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    counted = token_counts.token_counts(docs, token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model")), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.extract_main_text(pages).select("page_id", "url", "text")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, packing.byte_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents").select(*merkle.FIELDS))


#: Trees are lists of digests by level; crc32 of the id is computed bit by bit.
ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (
    SELECT doc_id, lang, text, n_chars, source, coalesce('.' || lang, '') AS tree,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
    FROM documents
), c AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other,
           xor(list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                   lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                   lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) AS crc
    FROM d
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM c
), levels(tree, level, nodes) AS (
    SELECT tree, 0, list(leaf ORDER BY r) FROM ranked GROUP BY tree
    UNION ALL
    SELECT tree, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))
    FROM levels WHERE len(nodes) > 1
), subroots AS (
    SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS r FROM levels WHERE len(nodes) = 1
), upper(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY r) FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))
    FROM upper WHERE len(nodes) > 1
), steps AS (
    SELECT k.doc_id, k.leaf, l.level AS place, l.nodes AS nodes, k.r // (8 ** l.level)::BIGINT AS i
    FROM ranked k JOIN levels l ON l.tree = k.tree AND len(l.nodes) > 1
    UNION ALL
    SELECT k.doc_id, k.leaf, 1000 + u.level, u.nodes, s.r // (8 ** u.level)::BIGINT
    FROM ranked k JOIN subroots s ON s.tree = k.tree JOIN upper u ON len(u.nodes) > 1
), sides AS (
    SELECT doc_id, leaf, place, array_to_string(nodes[i - i % 8 + 1:i], '') AS before,
           array_to_string(nodes[i + 2:i - i % 8 + 8], '') AS after FROM steps
), ways AS (
    SELECT doc_id, leaf, sha256(coalesce(string_agg(before || after, '' ORDER BY place), '')) AS proof_sha256,
           list([before, after] ORDER BY place) AS way
    FROM sides GROUP BY doc_id, leaf
), up AS (
    SELECT k.*, s.subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root, w.way,
           coalesce(w.proof_sha256, sha256('')) AS proof_sha256
    FROM ranked k JOIN subroots s ON s.tree = k.tree LEFT JOIN ways w ON w.doc_id = k.doc_id AND w.leaf = k.leaf
), folds AS (
    SELECT doc_id, leaf, subroot, root, proof_sha256,
           list_reduce(list_prepend([CASE WHEN crc % 3 = 0 THEN other ELSE leaf END, ''], coalesce(way, [])),
                       lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root
    FROM up
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    warc.write_archives(pages, folder)
    return warc.captures(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op12_warc"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op13_collocations"] = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), spots AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size
), totals AS (
    SELECT lang, count(*) AS n FROM spots WHERE size = 1 GROUP BY lang
), f AS (
    SELECT lang, size, phrase, count(*) AS a FROM spots GROUP BY lang, size, phrase HAVING count(*) >= 10
), cut AS (
    SELECT c.lang, c.phrase, c.size, c.a, k, x.a AS l, y.a AS r,
           CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size > 1) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut
), inside AS (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM f WHERE size = 3)
), ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
    FROM best b
    WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a)
)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, t.n, q.score FROM ranked q JOIN totals t ON t.lang = q.lang WHERE q.rank <= 2000
"""
