"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to reference
fingerprints (pivots). By the triangle inequality two fingerprints within
``bits`` of each other have distances to every pivot that differ by at most
``bits``; pairs with a larger coordinate difference are discarded, the others
are verified.

Pairs come from buckets. A single-bit pivot's distance, less that to the zero
pivot, is one bit of the fingerprint; four groups of such pivots are the four
16-bit parts. Two fingerprints that differ in 2 bits agree on two whole groups
at least, so an equality join on each pair of groups loses no link. Buckets of
more than ``BUCKET`` fingerprints are not joined with themselves: there each
fingerprint is written under itself and everything one bit away within the free
bits. Two fingerprints within 2 bits share such a key, and all that share one are
within 2 bits, so each key links its members to its smallest one, in linear space.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import checkpoint, connected_components, text_udf

SHINGLE_WORDS = 3
SEED = 42
BITS = 2
BUCKET = 48
N_PIVOTS = 16
#: Shingles hashed at once.
PART = 1 << 18
_GROUPS = tuple(0xFFFF << (16 * g) for g in range(4))
_PAIRS = tuple(combinations(range(4), 2))


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: pseudo-random, from the hash of their number."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=SEED) for i in range(n)]


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    line = b" ".join(found)
    count = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for low in range(0, count, PART):
        part = range(low, min(count, low + PART))
        hashes = np.array([digest(line[starts[i] : ends[i]], seed) for i in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > count).tolist())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (long); NULL and empty texts have 0."""
    run = text_udf("long", lambda: lambda texts: [signed(fingerprint(t)) for t in texts])
    return docs.withColumn(out, run(F.col(text)))


def distances(fp: Column) -> Column:
    """The pivot table's row: distances to all pivots."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("byte") for p in pivots()))


def near(a: Column, b: Column, table_a: Column, table_b: Column, bits: int = BITS) -> Column:
    """Discards by the largest coordinate difference, then verifies."""
    spread = F.greatest(*(F.abs(table_a[i] - table_b[i]) for i in range(N_PIVOTS)))
    return (spread <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def buckets(distinct: DataFrame) -> DataFrame:
    """(fp, pair, part): each fingerprint under the six pairs of pivot groups."""
    keys = [
        F.struct(F.lit(k).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(_GROUPS[a] | _GROUPS[b]))).alias("part"))
        for k, (a, b) in enumerate(_PAIRS)
    ]
    return distinct.select("fp", F.inline(F.array(*keys)))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between different fingerprints ``fp``: every fingerprint reaches all it must be linked with."""
    keyed = buckets(distinct)
    sizes = checkpoint(keyed.groupBy("pair", "part").agg(F.count("*").alias("n")).filter("n > 1"))
    # written once: the join may split a hot bucket, and only rows of small buckets are dealt by their key again
    shared = checkpoint(keyed.join(sizes, ["pair", "part"]))
    small = shared.filter(F.col("n") <= bucket).withColumn("table", distances(F.col("fp")))
    a, b = small.alias("a"), small.alias("b")
    condition = (
        (F.col("a.pair") == F.col("b.pair")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
        & near(F.col("a.fp"), F.col("b.fp"), F.col("a.table"), F.col("b.table"))
    )
    pairs = a.join(b, condition).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    free = F.array(*(
        F.array(*(F.lit(signed(1 << bit)) for bit in range(64) if not (_GROUPS[x] | _GROUPS[y]) >> bit & 1)) for x, y in _PAIRS
    ))
    around = F.concat(F.array("fp"), F.transform(free[F.col("pair").cast("int")], lambda bit: F.col("fp").bitwiseXOR(bit)))
    covered = shared.filter(F.col("n") > bucket).select("fp", "pair", F.explode(around).alias("ball"))
    # at most 33 fingerprints share a ball
    balls = covered.groupBy("pair", "ball").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members"))
    stars = balls.filter(F.size("members") > 1).select("a", F.explode("members").alias("b")).filter("a != b")
    return pairs.unionByName(stars)


def components(marked: DataFrame, least: Column) -> DataFrame:
    """``marked`` (with simhash) and ``least``: the smallest value of that expression that links reach.

    Documents with one fingerprint are one class from the start, so copies meet
    in aggregates and never in a join with each other.
    """
    found = connected_components(links(marked.select(F.col("simhash").alias("fp")).distinct()))
    tagged = marked.join(found, marked["simhash"] == found["node"], "left").drop("node")
    tagged = checkpoint(tagged.withColumn("component", F.coalesce("component", "simhash")))
    smallest = checkpoint(tagged.groupBy("component").agg(F.min(least).alias("least")))
    return tagged.join(smallest, "component").drop("component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, simhash, component_id): one row per document.

    ``component_id`` is the smallest doc_id that links of fingerprints reach. Rows
    whose id is NULL take part in links and get the component's smallest id (NULL
    if it has none).
    """
    marked = checkpoint(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return components(marked, F.col("doc_id")).withColumnRenamed("least", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (NULL ids last), then the smallest digest.

    A row is known by a digest of id and text; rows equal in both are one document and leave one row.
    """
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.col(doc_id).cast("string"), F.col(text)), 256))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("digest"))
    marked = checkpoint(fingerprints(narrow).drop("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    key = next(f"row_digest_{n}" for n in range(len(docs.columns) + 1) if f"row_digest_{n}" not in docs.columns)
    kept = components(marked, order).filter(F.col("digest") == F.col("least.digest")).select(F.col("digest").alias(key)).distinct()
    rows = docs.withColumn(key, digest).join(kept, key, "left_semi")
    return rows.dropDuplicates([key]).select(*docs.columns)
