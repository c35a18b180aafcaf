"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a unit vector; its cell is the signed axis nearest to it. Several
independent tables are kept. A query visits, in each table, the cells whose axes
are nearest to it (multiprobe); what it finds is ranked by exact inner products.

The inner product is searched as an angle: stored vectors fall into bands of
length (each at most twice as long as the shortest of its band), a band is hashed
by direction and every query visits every band. With several hash functions a table
the probes are the combinations of axes with the largest summed coordinates. Bands
are compared as a whole only up to ``whole_rows`` vectors, an argument that is 0
by default. Queries that found too few vectors search on in more cells, at last in
all.

A task holds a block of vectors with their cells in all tables and a part of the
queries: a vector travels once a part and a query once a block, however many cells
it visits, and of a query the best alone leave the task. No visit and no pair is
ever a row.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bound_batches, checkpoint, compact, map_rows, usable_vector

TABLES = 8
#: Cells a query visits in each table and for each hash function.
PROBES = 24
#: Rows a cell should hold on average; more rows get more hash functions for each table.
CELL_ROWS = 4096
#: Vectors of one block and queries of one part, at most; fewer where there would be less than ``TASKS`` of them together.
BLOCK_ROWS = 65_536
PART_QUERIES = 32_768
TASKS = 48
#: Queries of a part and vectors of a block where tables are small, at least.
LEAST_QUERIES, LEAST_ROWS = 2048, 4096
#: Vectors and queries whose products are in memory at a time.
SLICE_ROWS, SLICE_QUERIES = 4096, 256
#: Groups in which equal vectors of many partitions meet before they meet in one.
SALTS = 256
#: Vectors hashed in one task.
PART_ROWS = 4096
#: Sums of coordinates ranked at once.
PROBE_VALUES = 4_000_000
SEED = 17


def rotations(dim: int, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Random signs: (tables, hashes, 3, dim)."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    x, n, half = x.copy(), x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def cells_of(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, tables): the cell of each row; of several hash functions the axes are digits."""
    width = 2 * x.shape[1]
    out = np.zeros((len(x), len(signs)), np.int64)
    for t, functions in enumerate(signs):
        for s in functions:
            y = rotate(x, s)
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * width + 2 * axis + (y[np.arange(len(x)), axis] < 0)
    return out


def probes_of(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, at most probes ** hashes): cells of the largest sum of signed coordinates over the hash functions."""
    width = 2 * x.shape[1]
    most, rows = probes ** signs.shape[1], max(1, PROBE_VALUES // (width * probes ** signs.shape[1]))
    if len(x) > rows:
        return np.concatenate([probes_of(x[low : low + rows], signs, probes) for low in range(0, len(x), rows)])
    found = []
    for functions in signs:
        cells, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for n, s in enumerate(functions):
            y = rotate(x, s)
            signed = np.stack([y, -y], axis=2).reshape(len(x), width)
            best = np.argsort(-signed, axis=1, kind="stable")[:, : min(most, width)]
            # both are in order: what has ``most`` combinations before it is not among the best
            i, j = np.divmod(np.arange(cells.shape[1] * best.shape[1]), best.shape[1])
            i, j = i[(few := (i + 1) * (j + 1) <= most)], j[few]
            sums = sums[:, i] + np.take_along_axis(signed, best, 1)[:, j]
            cells = cells[:, i] * width + best[:, j]
            if n and n == len(functions) - 1 and sums.shape[1] > most:
                order = np.sort(np.argpartition(-sums, most - 1, axis=1)[:, :most], axis=1)  # the first place is the best
            else:
                order = np.argsort(-sums, axis=1, kind="stable")[:, :most]
            cells, sums = np.take_along_axis(cells, order, 1), np.take_along_axis(sums, order, 1)
        found.append(cells)
    return np.stack(found, axis=1)


def met(cells: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """(vectors, queries): whether a query visits the vector's cell in one of the tables, from (vectors, tables) and (queries, tables, visits)."""
    out = np.zeros((len(cells), len(probes)), bool)
    query = np.repeat(np.arange(len(probes)), probes.shape[2])
    for t in range(cells.shape[1]):
        held, place = np.unique(cells[:, t], return_inverse=True)
        wanted = probes[:, t].ravel()
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        hit = held[at] == wanted
        visited = np.zeros((len(held), len(probes)), bool)
        visited[at[hit], query[hit]] = True
        out |= visited[place]
    return out


def directions(v: np.ndarray, width: int) -> np.ndarray:
    """Vectors as points of the unit sphere, padded with zeros; scaled first, so that no square overflows."""
    out = np.zeros((len(v), width))
    if len(v):
        out[:, : v.shape[1]] = v / np.abs(v).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def vectors_of(data: list, dim: int, kind: type = np.float64) -> np.ndarray:
    """Stored bytes as rows in double precision; shorter vectors are filled with zeros."""
    out = np.zeros((len(data), dim))
    for row, b in zip(out, data):
        v = np.frombuffer(b, kind)
        row[: len(v)] = v
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best: largest score first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nearest_neighbours(
    table: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, cell_rows: int = CELL_ROWS, block_rows: int | None = None,
    whole_rows: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``table`` nearest to it, but for its own id.

    Score is the inner product of the original vectors in double precision. Equal
    vectors are one point of the index, which remembers its k + 1 smallest ids, so
    a vector that many rows share is searched and compared once, and results stay
    exact. Every query gets k rows where there are k. Vectors that are NULL, zero or hold NULL or non-finite components take
    no part, nor do rows with a NULL id. Repeated query rows get one result each.
    ``block_rows`` bounds the vectors of one task (``BLOCK_ROWS``).
    """
    keep = k + 1
    # what is stored as 4 bytes a component travels so
    kind = np.float32 if all(df.select(vector).schema[0].dataType.simpleString() == "array<float>" for df in (table, queries)) else np.float64

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        return df.filter(F.col("vec_id").isNotNull() & usable_vector(F.col("v")))

    def pack():
        def work(ids: list, vectors: list) -> list:
            # equal vectors of a slice meet here, at most k + 1 ids each
            groups: dict[bytes, list] = {}
            for i, v in zip(ids, vectors):
                groups.setdefault((np.asarray(v, kind) + kind(0)).tobytes(), []).append(i)
            least = [sorted(g)[:keep] for g in groups.values()]
            sizes = []
            for v in groups:
                top = np.abs(x := np.frombuffer(v, kind).astype(np.float64)).max()
                sizes.append(min(float(top) * math.sqrt(float(((x / top) ** 2).sum())), sys.float_info.max))
            return [list(groups), least, sizes, [len(v) // kind().itemsize for v in groups]]

        return work

    packed = map_rows(usable(table), "v binary, ids array<long>, size double, dim int", pack, rows=4096)
    least = [
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"),
        F.max("size").alias("size"), F.max("dim").alias("dim"),
    ]
    # a vector that many rows share meets first in groups of partitions
    salted = packed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    points = salted.groupBy("v", "salt").agg(*least).groupBy("v").agg(*least)
    points = checkpoint(points)
    shape = points.agg(F.count("*"), F.max("dim"), F.max("size"), F.sum(F.size("ids"))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not shape[0]:
        return table.sparkSession.createDataFrame([], empty)
    dim, longest = int(shape[1]), float(shape[2])
    need = min(keep, int(shape[3]))
    points, n_points = compact(points.withColumn("band", F.floor(F.log2(F.lit(longest)) - F.log2("size") + 1e-6).cast("int")), PART_ROWS)
    width = 1 << math.ceil(math.log2(dim))
    # hash functions of the bands that are hashed; doubles have some 2,100 bands at most
    counts = {row["band"]: row["n"] for row in points.groupBy("band").agg(F.count("*").alias("n")).collect()}
    hashes = {b: max(1, math.ceil(math.log(n / cell_rows) / math.log(2 * width))) for b, n in sorted(counts.items()) if n > whole_rows}
    signs = {h: rotations(width, tables, h) for h in set(hashes.values())}

    def pack_query():
        return lambda ids, vectors: [ids, [(np.asarray(v, kind) + kind(0)).tobytes() for v in vectors]]

    asked = checkpoint(map_rows(usable(queries), "query_id long, v binary", pack_query, rows=4096))
    # one search for each different query vector
    wanted, n_wanted = compact(checkpoint(asked.groupBy("v").agg(F.min("query_id").alias("query"))), PART_ROWS)

    def store():
        def work(data: list, ids: list, bands: list) -> list:
            x, bands = directions(vectors_of(data, dim, kind), width), np.array(bands, np.int64)
            cells = np.zeros((len(x), tables), np.int64)
            for b in np.unique(bands).tolist():
                if b in hashes:
                    cells[bands == b] = cells_of(x[bands == b], signs[hashes[b]])
            return [data, ids, bands, [c.tobytes() for c in cells]]

        return work

    stored = checkpoint(map_rows(points.select("v", "ids", "band"), "v binary, ids array<long>, band int, cells binary", store, rows=1024))
    most_rows = block_rows or BLOCK_ROWS

    def search(asking: DataFrame, n_asking: int, width_of_search: int | None) -> DataFrame:
        """(query, ids, scores): the best of each query among the vectors of the cells it visits, without a width among all."""

        def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
            schema = pa.schema([("query", pa.int64()), ("far", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
            if not held.num_rows or not asked.num_rows:
                return schema.empty_table()
            bands = held.column("band").to_numpy()
            order = np.argsort(bands, kind="stable")
            held, bands = held.take(pa.array(order)), bands[order]
            p = vectors_of(held.column("v").to_pylist(), dim, kind)
            cells = np.frombuffer(b"".join(held.column("cells").to_pylist()), np.int64).reshape(len(p), tables)
            members = held.column("ids").to_pylist()
            firsts = np.array([i[0] for i in members], np.int64)
            longest = np.sqrt((p * p).sum(axis=1)).max()
            queries, found = asked.column("query").to_numpy(), [[], [], []]
            for low in range(0, len(queries), SLICE_QUERIES):
                q = vectors_of(asked.column("v").slice(low, SLICE_QUERIES).to_pylist(), dim, kind)
                if width_of_search is not None:
                    x = directions(q, width)
                    visits = {h: probes_of(x, s, width_of_search) for h, s in signs.items()}
                limit, many, near = None, True, []
                for band in np.unique(bands).tolist():
                    first, last = np.searchsorted(bands, [band, band + 1])
                    whole = width_of_search is None or band not in hashes
                    seen = np.ones((last - first, len(q)), bool) if whole else met(cells[first:last], visits[hashes[band]])
                    for at in range(first, last, SLICE_ROWS):
                        meets = seen[at - first : at - first + SLICE_ROWS]
                        product = np.where(meets, p[at : min(at + SLICE_ROWS, last)] @ q.T, -np.inf)
                        # the least of the best so far; sums of a matrix product depend on its shape, so near it all stay
                        if many and len(product) >= keep:
                            here = np.partition(product.T, -keep, axis=1)[:, -keep]
                            limit = here if limit is None else np.maximum(limit, here)
                        if limit is not None:
                            slack = 1e-9 * (np.where(np.isfinite(limit), np.abs(limit), 0.0) + longest * np.sqrt((q * q).sum(axis=1)))
                            meets = meets & ~(product < limit - slack)
                        rows, columns = np.nonzero(meets)
                        near.append((rows + at, columns))
                        many = 50 * len(rows) > product.size
                rows, columns = (np.concatenate(c) for c in zip(*near))
                order = np.argsort(columns, kind="stable")
                edges, rows = np.searchsorted(columns[order], np.arange(len(q) + 1)), rows[order]
                for r in range(len(q)):
                    mine = rows[edges[r] : edges[r + 1]]
                    if not len(mine):
                        continue
                    exact = (p[mine] * q[r]).sum(axis=1)
                    hits = [(-exact[n], i) for n in best_of(exact, firsts[mine], keep) for i in members[mine[n]]]
                    hits = sorted(hits)[:keep]
                    for out, value in zip(found, (queries[low + r], [s for s, _ in hits], [i for _, i in hits])):
                        out.append(value)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

        parts = max(math.ceil(n_asking / PART_QUERIES), min(4, math.ceil(n_asking / LEAST_QUERIES)))
        blocks = max(math.ceil(n_points / most_rows), min(TASKS // parts, math.ceil(n_points / min(LEAST_ROWS, most_rows))), 1)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        place = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
        left = stored.withColumn("block", place(blocks)).withColumn("part", every(parts))
        right = asking.select("query", "v").withColumn("part", place(parts)).withColumn("block", every(blocks))
        by = ["block", "part"]
        best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query long, far array<double>, ids array<long>")
        # of each query a block hands on k + 1 ids
        hits = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "ids")))), 1, keep)
        best = best.groupBy("query").agg(hits.alias("hits"))
        return best.select("query", F.col("hits.ids").alias("ids"), F.transform("hits.far", lambda s: -s).alias("scores"))

    bound_batches(table.sparkSession)
    answers, asking, cells, n_asking = None, wanted, probes, n_wanted
    while n_asking:
        # the last resort: all vectors
        last = not hashes or (cells >= width and answers is not None)
        got = checkpoint(asking.select("query", "v").join(search(asking, n_asking, None if last else cells), "query", "left"))
        enough = F.coalesce(F.size("ids"), F.lit(0)) >= need
        full = got if last else got.filter(enough)
        answers = full if answers is None else answers.unionByName(full)
        if last:
            break
        asking = got.filter(~enough).select("query", "v")
        n_asking = asking.count()
        cells *= 2
    if answers is None:
        return table.sparkSession.createDataFrame([], empty)
    answers = answers.filter("ids IS NOT NULL").select("v", "ids", "scores")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    hits = asked.join(answers, "v").select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
