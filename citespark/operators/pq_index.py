"""A stored approximate index: inverted lists of product-quantised residuals.

A vector is made a unit vector, assigned to its nearest cell centre, and what is
left of it (the residual) is cut into parts, each replaced by the number of the
nearest word of that part's codebook. An entry is its key, cell and one byte a
part. A query meets the entries of its nearest cells (asymmetric: the query itself is
not quantised). Single-precision products with the words that codes stand for rule
most of them out; the similarity of the others is read from one table of products
per query, and the best are fetched and ranked by exact cosine.

The model (centres and codebooks) is fitted on a bounded sample; every row is
indexed. Entries are tables: later rows are appended, a deletion is a row without
cell, and the newest row of a key counts. A cell that has grown too large is split
in two without a new fit; only its own rows are coded again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citespark.functions.vectors import require_dimension
from citespark.operators.similarity import SIMILARITY_DIGITS, top_k

#: Rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Entries that one task compares with a part of the queries; most queries of a part, and those with tables at a time.
BLOCK_ROWS, PART_QUERIES, QUERY_ROWS = 1_000_000, 16_384, 1_024
#: Parts of queries to aim at: an entry is copied to each.
QUERY_PARTS = 48
#: Entries of a cell whose products are formed at a time, and entries kept for some queries by their products alone.
ENTRY_ROWS, WAITING_ROWS = 4096, 4_000_000
#: Ranges of queries, and of keys, between which vectors are compared: so many, or more so that a range holds no more rows than this.
RANGES, RANGE_ROWS = 7, 131_072
#: Pairs of vectors compared at a time.
PAIR_ROWS = 65_536
CODES = 256
ENTRIES = "key long, cell int, codes binary, version long"


@dataclass(frozen=True)
class PqModel:
    """Cell centres (unit rows) and, for each part of a residual, the words of its codebook."""

    centres: np.ndarray  # cells x dimensions
    words: np.ndarray  # parts x codes x dimensions of a part

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row without a direction becomes zero."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True), nan=0.0, posinf=0.0, neginf=0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by distance, the first of equals."""
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T), axis=1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centres of a matrix in memory; a centre that loses its rows moves to the row that lies worst."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        moved = total / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            error = ((x - centres[at]) ** 2).sum(axis=1)
            moved[empty] = x[np.argsort(-error, kind="stable")[: len(empty)]]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def train(
    vectors: DataFrame, vector: str = "embedding", n_cells: int = 64, n_parts: int = 16, key: str = "chunk_id",
    sample_rows: int = SAMPLE_ROWS, seed: int = 7,
) -> PqModel:
    """A model from at most ``sample_rows`` vectors, chosen by a hash of the key."""
    rows = vectors.filter(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    taken = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample_rows).toArrow().column("vec").to_pylist()
    if not taken:
        raise ValueError("an index needs at least one vector to be fitted")
    x = unit_rows(np.array(taken, np.float64))
    if x.shape[1] % n_parts:
        raise ValueError(f"{x.shape[1]} dimensions do not fall into {n_parts} equal parts")
    centres = unit_rows(k_means(x, n_cells, seed))
    left = (x - centres[nearest(x, centres)]).reshape(len(x), n_parts, -1)
    books = [k_means(left[:, part], CODES, seed + part) for part in range(n_parts)]
    words = np.zeros((n_parts, CODES, left.shape[2]))
    for part, book in enumerate(books):
        words[part, : len(book)] = book
        words[part, len(book) :] = book[0]  # never nearer than the first
    return PqModel(centres, words)


def code(model_centres: np.ndarray, words: np.ndarray, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The codes (rows x parts, bytes) of unit rows in given cells."""
    left = (x - model_centres[cell]).reshape(len(x), len(words), -1)
    return np.stack([nearest(left[:, part], words[part]) for part in range(len(words))], axis=1).astype(np.uint8)


def _usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return rows.select(F.col(key).cast("long").alias("key"), require_dimension(F.col(vector), dim).cast("array<double>").alias("vec"))


def encode(vectors: DataFrame, model: PqModel, version: int = 0, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The entries of a vector table: a narrow job. Rows without a vector have none; another dimension is an error."""
    shared = vectors.sparkSession.sparkContext.broadcast((model.centres, model.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, words = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            cell = nearest(x, centres)
            codes = [row.tobytes() for row in code(centres, words, x, cell)]
            arrays = [batch.column(0), pa.array(cell, pa.int32()), pa.array(codes, pa.binary()), pa.array([version] * len(codes), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "cell", "codes", "version"])

    return _usable(vectors, key, vector, model.dim).mapInArrow(run, ENTRIES)


def deletions(keys: DataFrame, version: int, key: str = "chunk_id") -> DataFrame:
    """Entries that take keys out of the index as of a version."""
    none = F.lit(None)
    return keys.select(
        F.col(key).cast("long").alias("key"), none.cast("int").alias("cell"), none.cast("binary").alias("codes"), F.lit(version).cast("long").alias("version")
    )


def live(entries: DataFrame) -> DataFrame:
    """The newest entry of each key, without deleted ones; of one version's rows a deletion comes last."""
    order = F.struct("version", F.col("cell").isNull().alias("gone"), "cell", "codes")
    newest = entries.groupBy("key").agg(F.max(order).alias("last"))
    return newest.filter("last.cell IS NOT NULL").select("key", "last.cell", "last.codes", "last.version")


def split_cells(entries: DataFrame, vectors: DataFrame, model: PqModel, max_rows: int, version: int, key: str = "chunk_id", vector: str = "embedding") -> tuple[DataFrame, PqModel]:
    """(new entries, model): cells of more than ``max_rows`` live entries get a second centre, the codebooks stay.

    Two centres come from a bounded sample of each such cell, and the rows of these
    cells alone are coded again, as a later version. Append the entries to keep them.
    """
    now = live(entries)
    large = [r["cell"] for r in now.groupBy("cell").count().filter(F.col("count") > max_rows).select("cell").collect()]
    if not large:
        return entries.limit(0), model
    rows = _usable(vectors, key, vector, model.dim).join(now.filter(F.col("cell").isin(large)).select("key", "cell"), "key")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.xxhash64("key"), "key")))
    sample = ranked.filter(F.col("n") <= max(1, SAMPLE_ROWS // (64 * len(large)))).select("cell", "vec").toArrow()
    cells, x = np.array(sample.column("cell").to_pylist()), unit_rows(np.array(sample.column("vec").to_pylist(), np.float64))
    centres = model.centres.copy()
    for cell in sorted(large):
        two = unit_rows(k_means(x[cells == cell], 2, cell))
        centres[cell] = two[0]
        centres = np.vstack([centres, two[1:]])
    split = PqModel(centres, model.words)
    return encode(rows.select("key", "vec"), split, version, "key", "vec"), split


def search(
    queries: DataFrame, entries: DataFrame, vectors: DataFrame, model: PqModel, *, k: int, min_similarity: float = -1.0, n_probe: int = 8,
    rerank: int = 100, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): approximate top-k above a threshold, with exact similarities.

    The ``rerank`` best entries of each query by their codes are compared exactly.
    A task holds a part of the queries and a block of the entries, cell by cell, so
    that it hands on ``rerank`` entries of a query for all its cells together; only
    codes are copied to the parts, never vectors. Parts grow with the queries, and
    there are more than ``QUERY_PARTS`` of them only when a part is full.
    """
    spark: SparkSession = queries.sparkSession
    now = live(entries).select("key", "cell", "codes")
    sizes = {r["cell"]: r["count"] for r in now.groupBy("cell").count().collect()}
    filled = np.array([sizes.get(cell, 0) > 0 for cell in range(len(model.centres))])
    blocks = max(1, math.ceil(sum(sizes.values()) / BLOCK_ROWS))
    shared = spark.sparkContext.broadcast((model.centres, model.words, filled))
    q = _usable(queries, query_id, vector, model.dim)
    n = q.count()
    parts = max(1, math.ceil(n / min(PART_QUERIES, max(QUERY_ROWS, math.ceil(n / QUERY_PARTS)))))
    salt = F.abs(F.xxhash64("key") % 1_000_003)
    left = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("qpart", (salt % parts).cast("int"))
    right = now.withColumn("part", (salt % blocks).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("near", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        centres, words, filled = shared.value
        place = held.column("cell").to_numpy()
        order = np.argsort(place, kind="stable")
        ids = held.column("key").to_numpy()[order]
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        edges = np.searchsorted(place[order], np.arange(len(centres) + 1))
        place = place[order]
        # products in single precision are below ``reach`` and as near to the sums of the tables as ``slack``
        reach = 1.5 + np.sqrt((words * words).sum(axis=2).max(axis=1).sum())
        slack = 4 * centres.shape[1] * float(np.finfo(np.float32).eps) * reach
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, asked.num_rows, QUERY_ROWS):
            some = asked.slice(lo, QUERY_ROWS)
            x = unit_rows(np.array(some.column("vec").to_pylist(), np.float64))
            base = x @ centres.T
            cells = np.argsort(-np.where(filled[None, :], base, -np.inf), axis=1, kind="stable")[:, : min(n_probe, int(filled.sum()))]
            tables = np.einsum("qpd,pcd->qpc", x.reshape(len(x), len(words), -1), words)
            meets = np.zeros(base.shape, bool)
            np.put_along_axis(meets, cells, True, axis=1)
            short = x.astype(np.float32)
            # of each query: the similarity of the last of its best, from below
            floor = np.full(len(x), -np.inf)
            kept: list[tuple[np.ndarray, ...]] = []
            held_back, due = 0, 2 * rerank * len(x)

            def raised(kept: list) -> list:
                """The entries that can still be among the best, after the floors have been raised to the best so far."""
                q, e, near = (np.concatenate(c) for c in zip(*kept))
                # products are below ``reach``, so one sort puts them in order query by query
                line = np.sort(2 * reach * q - near)
                first = np.searchsorted(line, 2 * reach * np.arange(len(x) + 1) - reach)
                full = np.flatnonzero(np.diff(first) >= rerank)
                floor[full] = np.maximum(floor[full], 2 * reach * full - line[first[full] + rerank - 1] - slack)
                still = near >= floor[q] - slack
                return [(q[still], e[still], near[still])]

            def ranked(kept: list) -> tuple:
                """The best by the sums of the tables, equals by key."""
                q, e, _ = (np.concatenate(c) for c in zip(*kept))
                near = base[q, place[e]]
                for part in range(len(words)):
                    near += tables[q, part, codes[e, part]]
                order = np.lexsort((ids[e], -near, q))
                q, e, near = q[order], e[order], near[order]
                last = np.arange(len(q)) - np.searchsorted(q, q) < rerank
                return q[last], e[last], near[last]

            for cell in np.flatnonzero(meets.any(axis=0)):
                rows = np.flatnonzero(meets[:, cell])
                mine = short[rows]
                for at in range(edges[cell], edges[cell + 1], ENTRY_ROWS):
                    own = codes[at : min(at + ENTRY_ROWS, edges[cell + 1])]
                    stands_for = centres[cell] + words[np.arange(len(words)), own].reshape(len(own), -1)
                    near = mine @ stands_for.astype(np.float32).T
                    if len(own) > rerank and np.isneginf(floor[rows]).any():
                        floor[rows] = np.maximum(floor[rows], np.partition(near, -rerank, axis=1)[:, -rerank] - slack)
                    hit = np.flatnonzero(near >= (floor[rows] - slack).astype(np.float32)[:, None])
                    q, e = np.divmod(hit, len(own))
                    kept.append((rows[q], at + e, near.ravel()[hit].astype(np.float64)))
                    held_back += len(hit)
                    if held_back > due:
                        kept = raised(kept)
                        if len(kept[0][0]) > WAITING_ROWS:  # many are as near as equal
                            kept = [ranked(kept)]
                        held_back = 0
            best = ranked(kept) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            out.append((some.column("key").to_numpy()[best[0]], ids[best[1]], best[2]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    by = ["part", "qpart"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, "query long, key long, near double")
    if blocks > 1:
        order = Window.partitionBy("query").orderBy(F.desc("near"), "key")
        near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rerank)
    found = _compared(near.select("query", "key"), queries, vectors, model.dim, query_id, chunk_id, vector, max(n, sum(sizes.values())), k, min_similarity)
    return top_k(found, query_id, chunk_id, k)


def _compared(
    pairs: DataFrame, queries: DataFrame, vectors: DataFrame, dim: int, query_id: str, chunk_id: str, vector: str, rows: int, k: int, min_similarity: float,
) -> DataFrame:
    """(query_id, chunk_id, similarity) of pairs above the threshold, by exact cosine; at most ``k`` a query leave a task.

    Queries and keys fall into ranges, and a task has the pairs between two of
    them: a vector travels once a range of the other side, not once a pair.
    """
    ranges = max(RANGES, math.ceil(rows / RANGE_ROWS))
    number = lambda c: F.pmod(F.xxhash64(c, F.lit(ranges)), F.lit(ranges)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))

    def sided(df: DataFrame, key: str, asked: bool) -> DataFrame:
        # vectors travel as they are stored and are widened where they are compared
        df = df.filter(F.size(vector) > 0).select(F.col(key).cast("long").alias("id"), require_dimension(F.col(vector), dim).alias("vec"), F.lit(asked).alias("asked"))
        return df.withColumn("from", number("id") if asked else every).withColumn("to", every if asked else number("id"))

    def compare(wanted: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([(query_id, pa.int64()), (chunk_id, pa.int64()), ("similarity", pa.float64())])
        if not wanted.num_rows or not held.num_rows:
            return schema.empty_table()
        asked = held.column("asked").to_numpy().astype(bool)
        own, x = held.column("id").to_numpy(), held.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        sides, there = [], np.ones(wanted.num_rows, bool)
        for name, side in (("query", asked), ("key", ~asked)):
            at = np.flatnonzero(side)
            at = at[np.argsort(own[at], kind="stable")]
            ids = wanted.column(name).to_numpy()
            if not len(at):
                return schema.empty_table()
            place = at[np.minimum(np.searchsorted(own[at], ids), len(at) - 1)]
            there &= own[place] == ids
            sides.append(place)
        q, c = (side[there] for side in sides)
        near = np.zeros(len(q))
        for lo in range(0, len(q), PAIR_ROWS):
            a, b = (x[side[lo : lo + PAIR_ROWS]].astype(np.float64) for side in (q, c))
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                length = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
                near[lo : lo + PAIR_ROWS] = np.where(length > 0, np.round((a * b).sum(axis=1) / length, SIMILARITY_DIGITS), np.nan)
        above = near > min_similarity
        q, c, near = own[q[above]], own[c[above]], near[above]
        order = np.lexsort((c, -near, q))
        q, c, near = q[order], c[order], near[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.Table.from_arrays([pa.array(q[kept]), pa.array(c[kept]), pa.array(near[kept])], schema=schema)

    left = pairs.withColumn("from", number("query")).withColumn("to", number("key"))
    right = sided(queries, query_id, True).unionByName(sided(vectors, chunk_id, False))
    return left.groupBy("from", "to").cogroup(right.groupBy("from", "to")).applyInArrow(compare, f"`{query_id}` long, `{chunk_id}` long, similarity double")


def save_model(spark: SparkSession, model: PqModel, folder: str) -> None:
    """Centres and codebooks as two small tables."""
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/cells")
    rows = [(p, c, w.tolist()) for p, book in enumerate(model.words) for c, w in enumerate(book)]
    spark.createDataFrame(rows, "part int, code int, word array<double>").write.mode("overwrite").parquet(f"{folder}/words")


def load_model(spark: SparkSession, folder: str) -> PqModel:
    centres = [r["centre"] for r in spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()]
    rows = spark.read.parquet(f"{folder}/words").orderBy("part", "code").collect()
    words = np.array([r["word"] for r in rows], np.float64)
    return PqModel(np.array(centres, np.float64), words.reshape(rows[-1]["part"] + 1, CODES, -1))
