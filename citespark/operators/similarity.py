"""Exact and approximate top-k cosine joins between two vector tables.

Three physical forms share one result contract (query, chunk, similarity, rank):

* few queries (their number is checked against a bound): the query matrix goes
  to every task, chunk partitions are scanned where they lie, and each task
  hands on at most k rows per query. The chunk table is never shuffled.
* many queries: queries are dealt into parts of bounded size, neighbours
  together, and chunks are grouped into cells. A task holds one part of queries
  and reads the chunks cell by cell. A query meets only cells it can reach: by
  the triangle inequality on angles no cell outside ``angle(q, centre) -
  radius`` can hold a pair above the threshold, so the result stays exact. A
  chunk is copied once per part that meets its cell; the number of parts, and
  with it the copies of a chunk, stays the same until a part is full.
* approximate: the same join, but each query meets its nearest cells.

Pairs live only inside a task as a bounded matrix product in single precision.
Those that its error leaves a chance are worked out in double precision; what
leaves a task are winners alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citespark.functions.vectors import require_dimension

BROADCAST_QUERIES = 4096
BLOCK_ROWS = 65536
QUERY_BLOCK_ROWS = 16384
# queries and chunks of one product, and pairs worked out in double precision at a time
MATRIX_ROWS = 512
TILE_ROWS = 2048
EXACT_PAIRS = 65536
# parts into which queries are dealt; a chunk is copied to each at most once
QUERY_PARTS = 48
# vectors from which the centres of an exact join are fitted; every row is placed, and the result does not depend on them
TRAIN_ROWS = 65536
# Equal vectors must tie whatever block they sit in; sums differ in the last bits.
SIMILARITY_DIGITS = 12
ANGLE_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column without nulls and with one common length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0)))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / length


def _packed(column: str, kind: str) -> Column:
    """The numbers of a list as bytes: Spark measures a batch of lists anew at every row, which costs more than the row."""

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: np.asarray(v, kind).tobytes(), na_action="ignore")

    return pack(F.col(column))


def _kind(df: DataFrame, column: str) -> str:
    """Numbers in which the vectors of a column are packed without loss."""
    return "<f4" if isinstance(_type_of(df, column).elementType, T.FloatType) else "<f8"


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of numbers of a column from ``_packed`` whose lists have one common length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Block:
    """Unit rows of queries that meet chunks; a pair counts from the floor of its query on.

    ``related`` compares what the two rows of a pair hold as their group.
    """

    def __init__(self, unit: np.ndarray, own: np.ndarray | None, related: Callable | None, floor: float, tile: int) -> None:
        usable = np.isfinite(unit).all(axis=1)
        self.unit = np.where(usable[:, None], unit, 0.0)
        self.small = self.unit.astype(np.float32)
        self.own, self.related = own, related
        self.floor = np.where(usable, floor, np.inf)
        self.tile = max(1, min(tile, TILE_ROWS))
        # twice the most by which a product of unit rows in single precision can be off
        self.slack = (unit.shape[1] + 8) * 2.0**-23

    def meet(self, rows: np.ndarray | None, held: np.ndarray, keys: np.ndarray, other: np.ndarray | None) -> None:
        """All pairs of the queries with these numbers (None: all queries) and these chunks."""
        usable = np.isfinite(held).all(axis=1)
        if not usable.all():
            held, keys, other = held[usable], keys[usable], None if other is None else other[usable]
        small = held.astype(np.float32)
        asked = self.small if rows is None else self.small[rows]
        numbers = np.arange(len(asked)) if rows is None else rows
        for at in range(0, len(held), self.tile):
            cut = slice(at, at + self.tile)
            part = np.ascontiguousarray(small[cut].T)
            for lo in range(0, len(asked), MATRIX_ROWS):
                near = asked[lo : lo + MATRIX_ROWS] @ part
                self.take(near, numbers[lo : lo + MATRIX_ROWS], held[cut], keys[cut], None if other is None else other[cut])
            self.settle()

    def low(self, numbers: np.ndarray) -> np.ndarray:
        return (self.floor[numbers] - self.slack).astype(np.float32)[:, None]

    def exact(self, q: np.ndarray, held: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for lo in range(0, len(q), EXACT_PAIRS):
            cut = slice(lo, lo + EXACT_PAIRS)
            out[cut] = np.einsum("ij,ij->i", self.unit[q[cut]], held[c[cut]])
        return np.round(out, SIMILARITY_DIGITS)

    def settle(self) -> None:
        pass


class _TopK(_Block):
    """The best ``k`` chunks of each query, ties by chunk id."""

    def __init__(self, unit, own, related, floor: float, tile: int, k: int) -> None:
        super().__init__(unit, own, related, floor, tile)
        self.k, self.best, self.found, self.pending = k, None, [], 0

    def take(self, near, numbers, held, keys, other) -> None:
        q, c = np.divmod(np.flatnonzero(near >= self.low(numbers)), near.shape[1])
        if self.related is not None:
            keep = self.related(self.own[numbers[q]], other[c])
            q, c = q[keep], c[keep]
        many = len(q) > 4 * self.k * len(numbers)
        if many:
            ranked = np.full(near.shape, -np.inf, np.float32)
            ranked[q, c] = near[q, c]
            kth = np.partition(ranked, -self.k, axis=1)[:, -self.k] - 2 * self.slack
            keep = near[q, c] >= kth[q]
            q, c = q[keep], c[keep]
        query = numbers[q]
        sims = self.exact(query, held, c)
        keep = sims >= self.floor[query]
        found = (query[keep], sims[keep], keys[c[keep]])
        if many:
            found = _best(*found, self.k)
        if len(found[0]):
            self.found.append(found)
            self.pending += len(found[0])

    def settle(self, last: bool = False) -> None:
        """Cuts what was found to k rows a query, whose worst is the floor from then on."""
        known = 0 if self.best is None else len(self.best[0])
        if not self.found or (not last and 2 * self.pending < known):
            return
        parts = self.found if self.best is None else [self.best, *self.found]
        self.best = _best(*(np.concatenate(column) for column in zip(*parts)), self.k)
        self.found, self.pending = [], 0
        q, sims, _ = self.best
        full = np.bincount(q, minlength=len(self.floor)) >= self.k
        ends = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
        ends = ends[full[q[ends]]]
        self.floor[q[ends]] = np.maximum(self.floor[q[ends]], sims[ends])

    def rows(self, keys: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.settle(last=True)
        if self.best is not None:
            q, sims, chunk = self.best
            yield pa.RecordBatch.from_pydict(
                {"query_key": list(keys[q]), "chunk_key": list(chunk), "similarity": sims}, schema=schema
            )


class _Counts(_Block):
    """How many chunks reach the floor of each query."""

    def __init__(self, unit, own, related, floor: float, tile: int) -> None:
        super().__init__(unit, own, related, floor, tile)
        self.total = np.zeros(len(unit), np.int64)

    def take(self, near, numbers, held, keys, other) -> None:
        floor = self.floor[numbers]
        sure = near >= (floor + self.slack).astype(np.float32)[:, None]
        doubt = (near >= self.low(numbers)) & ~sure
        if self.related is not None:
            counted = self.related(self.own[numbers][:, None], other[None, :])
            sure &= counted
            doubt &= counted
        self.total[numbers] += np.count_nonzero(sure, axis=1)
        q, c = np.divmod(np.flatnonzero(doubt), near.shape[1])
        passed = self.exact(numbers[q], held, c) >= floor[q]
        self.total[numbers] += np.bincount(q[passed], minlength=len(numbers))

    def rows(self, keys: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        met = np.flatnonzero(self.total)
        yield pa.RecordBatch.from_pydict({"query_key": list(keys[met]), "n": self.total[met]}, schema=schema)


def _best(q: np.ndarray, sims: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each query by similarity, ties by chunk id."""
    tie = pd.factorize(keys, sort=True)[0] if keys.dtype == object else keys
    order = np.lexsort((tie, -sims, q))
    q = q[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])[: len(q)]
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = nth < k
    return q[keep], sims[order][keep], keys[order][keep]


def _differ(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return own != other


def _share(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rows of bucket numbers that are equal in one place at least."""
    return (own == other).any(axis=1)


def _strictly_above(threshold: float) -> float:
    """Smallest rounded similarity that is above the threshold."""
    return float(np.nextafter(threshold, np.inf))


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_pandas().to_numpy()


def _groups(column: pa.Array, related: Callable | None, listed: bool = False) -> np.ndarray | None:
    """What ``related`` compares: a value a row, or a row of (packed) bucket numbers."""
    if related is None:
        return None
    return _unpacked(column, "<i8") if listed else _ids(column)


def _vectors(df: DataFrame, key: str, vector: str, group: str | None, dim: int | None) -> DataFrame:
    """Key, vector and exclusion group of the rows that can take part.

    Rows without a vector (NULL or empty) are not embedded yet. A vector of
    another length than ``dim`` is an error of the job in every physical form.
    """
    vec = F.col(vector) if dim is None else require_dimension(F.col(vector), dim)
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(key).alias("key"),
        vec.alias("vec"),
        (F.lit(None).cast("string") if group is None else F.col(group)).alias("grp"),
    )


def _common_dimension(sizes: list[int], dim: int | None) -> int:
    """The one length of the query vectors, which must be ``dim`` where that is given."""
    wrong = sorted({n for n in sizes if n != (sizes[0] if dim is None else dim)})
    if wrong:
        raise ValueError(f"expected query vectors of {sizes[0] if dim is None else dim} dimensions, got {wrong}")
    return sizes[0]


def top_k(candidates: DataFrame, query_id: str, chunk_id: str, k: int) -> DataFrame:
    """Best k rows per query by similarity, ties by chunk id, with their rank."""
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.col(chunk_id))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _result_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_key", q.schema["key"].dataType),
            T.StructField("chunk_key", c.schema["key"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType: pa.string(), T.DoubleType: pa.float64()}
    return pa.schema([(f.name, kinds.get(type(f.dataType), pa.int64())) for f in schema])


def _scan_chunks(
    chunks: DataFrame, schema: T.StructType, head: pa.Table, make: Callable, has_group: bool
) -> DataFrame:
    """Every task scores its own chunk partition against all (few) queries."""
    related = _differ if has_group else None
    shared = chunks.sparkSession.sparkContext.broadcast(
        (_ids(head["key"]), _matrix(head["vec"]), _groups(head["grp"], related))
    )
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, unit, own = shared.value
        block = make(unit, own, related)
        for batch in batches:
            if batch.num_rows:
                block.meet(None, _matrix(batch.column(1)), _ids(batch.column(0)), _groups(batch.column(2), related))
        yield from block.rows(keys, arrow)

    return chunks.mapInArrow(scan, schema)


@dataclass(frozen=True)
class CellIndex:
    """Cell centres (unit rows), the angular radius and the block count of each cell."""

    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    @property
    def n_cells(self) -> int:
        return len(self.centres)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the rows that have a direction."""
    for batch in batches:
        column = batch.column(0)
        if len(column):
            _common_dimension(column.value_lengths().unique().to_pylist(), None)
            unit = _matrix(column)
            unit = unit[np.isfinite(unit).all(axis=1)]
            offsets = np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, unit.ravel())], ["v"])


def _fitted_centres(chunks: DataFrame, n_cells: int) -> np.ndarray:
    """Centres from at most about ``TRAIN_ROWS`` of the chunks (key, vec), chosen by a hash of their keys."""
    share = TRAIN_ROWS / max(1, chunks.count())
    if share < 1:
        chunks = chunks.filter(F.pmod(F.xxhash64("key"), F.lit(2**20)) < math.ceil(share * 2**20))
    return train_centres(chunks, "vec", n_cells)


def train_centres(
    vectors: DataFrame,
    vector: str,
    n_cells: int,
    seed: int = 7,
    max_iter: int = 10,
) -> np.ndarray:
    """Unit cell centres from k-means on all unit vectors (at most ``n_cells`` rows).

    Pass a sample of the table to train on less; every row is assigned and
    compared in any case.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    raw = vectors.filter(F.size(vector) > 0).select(F.col(vector).alias("v"))
    unit = raw.mapInArrow(_unit_rows, "v array<double>").select(array_to_vector("v").alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(unit)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def assign_cells(df: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """The table with its nearest cell and the angle to that centre; a narrow job.

    Write the result partitioned by ``cell`` to keep it as an index table.
    """
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        unit = np.stack(vec.to_list()).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        sims = np.clip(np.nan_to_num(unit @ shared.value.T, nan=-1.0), -1.0, 1.0)
        cell = sims.argmax(axis=1)
        return pd.DataFrame(
            {"cell": cell.astype("int32"), "angle": np.arccos(sims[np.arange(len(cell)), cell])}
        )

    dim = centres.shape[1]
    return (
        df.filter(F.size(vector) == dim)
        .withColumn("_near", nearest(F.col(vector)))
        .withColumn("cell", F.col("_near.cell"))
        .withColumn("angle", F.col("_near.angle"))
        .drop("_near")
    )


def build_cell_index(
    indexed: DataFrame, centres: np.ndarray, block_rows: int = BLOCK_ROWS
) -> CellIndex:
    """Radius and block count per cell: one aggregate with at most ``n_cells`` rows."""
    radius = np.full(len(centres), -np.inf)
    blocks = np.zeros(len(centres), dtype=np.int64)
    stats = indexed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    for row in stats.collect():
        radius[row["cell"]] = row["radius"]
        blocks[row["cell"]] = math.ceil(row["n"] / block_rows)
    return CellIndex(centres, radius, blocks)


def _reachable(index: CellIndex, threshold: float, n_probe: int | None) -> Callable:
    """Cells a query has to meet: all it can reach, or its nearest ``n_probe``."""

    def cells(unit: np.ndarray) -> list[np.ndarray]:
        angle = np.arccos(np.clip(unit @ index.centres.T, -1.0, 1.0))
        filled = index.blocks > 0
        if n_probe is not None:
            ranked = np.argsort(np.where(filled[None, :], angle, np.inf), axis=1)[:, :n_probe]
            return [r[filled[r]].astype("int32") for r in ranked]
        limit = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
        reach = (angle - index.radius[None, :] <= limit) & filled[None, :]
        return [np.flatnonzero(r).astype("int32") for r in reach]

    return cells


def _placed(q: DataFrame, index: CellIndex, threshold: float, n_probe: int | None) -> DataFrame:
    """Queries with the cells they have to meet and the cell they lie in (``home``)."""
    # plain arrays: a broadcast value of our own class would need this package on the workers
    shared = q.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.blocks))

    @F.pandas_udf("struct<home:int,cells:array<int>>")
    def place(vec: pd.Series) -> pd.DataFrame:
        rows = np.stack(vec.to_list()).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            rows = np.nan_to_num(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        index = CellIndex(*shared.value)
        home = (rows @ index.centres.T).argmax(axis=1).astype("int32")
        return pd.DataFrame({"home": home, "cells": _reachable(index, threshold, n_probe)(rows)})

    placed = q.withColumn("_place", place(F.col("vec")))
    return placed.select("key", "vec", "grp", F.col("_place.home").alias("home"), F.col("_place.cells").alias("cells"))


def _part_rows(n: int, query_block_rows: int) -> int:
    """Queries of one part: as many as leave ``QUERY_PARTS`` parts, but no small fraction of a block and no more than fit a task."""
    return min(max(math.ceil(n / QUERY_PARTS), min(query_block_rows, MATRIX_ROWS)), QUERY_BLOCK_ROWS)


def _block_join(
    placed: DataFrame,
    chunks: DataFrame,
    schema: T.StructType,
    make: Callable,
    related: Callable | None,
    query_block_rows: int,
) -> DataFrame:
    """Every part of queries (:func:`_placed`) meets the chunks (key, vec, grp, cell) of the cells that it needs.

    A task holds the queries of one part and the winners of each; chunks pass it in batches.
    """
    sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}
    homes = sorted(sizes)
    starts = np.cumsum([0, *[sizes[h] for h in homes]]).tolist()
    rows = _part_rows(starts[-1], query_block_rows)
    n_parts = max(1, math.ceil(starts[-1] / rows))
    # queries lie in the order of their homes, by a hash of the key within one; each stretch of that order is a part
    span = [F.array(*[F.lit(int(v)) for v in values]) for values in ([0, *starts], [1, *[sizes[h] for h in homes], 1])]
    at = F.array_position(F.array(*[F.lit(int(h)) for h in homes]), F.col("home")).cast("int") if homes else F.lit(0)
    place = F.get(span[0], at) + F.pmod(F.xxhash64("key"), F.get(span[1], at))
    parted = placed.withColumn("qpart", F.floor(place / rows).cast("int"))
    needed = parted.select("qpart", F.explode("cells").alias("cell")).distinct()
    none = F.lit(None)
    kinds = _kind(placed, "vec"), _kind(chunks, "vec")
    listed = isinstance(_type_of(placed, "grp"), T.ArrayType)
    group = _packed("grp", "<i8").alias("grp") if listed else F.col("grp")
    left = parted.select(
        "qpart", F.lit(0).alias("side"), F.lit(-1).alias("cell"), F.col("key").alias("query_key"),
        none.cast(_type_of(chunks, "key")).alias("chunk_key"), _packed("vec", kinds[0]).alias("vec"), group,
        _packed("cells", "<i4").alias("cells"),
    )
    # packed before they are copied to the parts
    packed = chunks.select("key", "cell", _packed("vec", kinds[1]).alias("vec"), group)
    right = packed.join(F.broadcast(needed), "cell").select(
        "qpart", F.lit(1).alias("side"), "cell", none.cast(_type_of(placed, "key")).alias("query_key"),
        F.col("key").alias("chunk_key"), "vec", "grp", none.cast("binary").alias("cells"),
    )
    both = left.unionByName(right).repartitionById(n_parts, "qpart").sortWithinPartitions("qpart", "side", "cell")
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, block, keys, meets = None, [], None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(name).to_numpy() for name in ("qpart", "side", "cell")]
            changes = np.flatnonzero(np.logical_or.reduce([np.diff(m) != 0 for m in marks])) + 1
            for lo, hi in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                if marks[0][lo] != part:
                    if block is not None:
                        yield from block.rows(keys, arrow)
                    part, waiting, block = marks[0][lo], [], None
                piece = batch.slice(lo, hi - lo)
                if marks[1][lo] == 0:
                    waiting.append(piece)
                    continue
                if block is None:
                    asked = pa.Table.from_batches(waiting)
                    waiting, keys, meets = [], _ids(asked["query_key"]), _met_by(asked["cells"])
                    block = make(_unit(_unpacked(asked["vec"], kinds[0]).astype(np.float64)), _groups(asked["grp"], related, listed), related)
                numbers = meets[int(marks[2][lo])]
                block.meet(
                    None if len(numbers) == len(keys) else numbers,
                    _unit(_unpacked(piece.column("vec"), kinds[1]).astype(np.float64)), _ids(piece.column("chunk_key")),
                    _groups(piece.column("grp"), related, listed),
                )
        if block is not None:
            yield from block.rows(keys, arrow)

    return both.mapInArrow(run, schema)


def _type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def _met_by(cells: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Numbers of the queries that meet each cell."""
    lists = [np.frombuffer(packed, "<i4") for packed in cells.to_pylist()]
    flat = np.concatenate(lists)
    query = np.repeat(np.arange(len(lists)), [len(met) for met in lists])
    order = np.argsort(flat, kind="stable")
    values, first = np.unique(flat[order], return_index=True)
    return dict(zip(values.tolist(), np.split(query[order], first[1:]), strict=True))


def _top_k_maker(k: int, min_similarity: float, tile: int = BLOCK_ROWS) -> Callable:
    floor = _strictly_above(min_similarity)
    return lambda unit, own, related: _TopK(unit, own, related, floor, tile, k)


def similarity_join(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int,
    min_similarity: float,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    exclude: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    n_cells: int = 64,
    block_rows: int = BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    centres: np.ndarray | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Exact top-k chunks per query with cosine similarity strictly above the threshold.

    All vectors have ``dim`` elements (default: as many as the queries have);
    others are an error. Beyond ``broadcast_queries`` queries ``centres`` of a
    stored index spare the training. ``exclude`` names a column of both tables; pairs with equal values are left
    out before the top-k (a paper is no neighbour of itself).
    """
    q = _vectors(queries, query_id, vector, exclude, None)
    head = q.limit(broadcast_queries + 1).toArrow()
    make = _top_k_maker(k, min_similarity, block_rows)
    if not head.num_rows:
        c = _vectors(chunks, chunk_id, vector, exclude, None)
        found = q.sparkSession.createDataFrame([], _result_schema(q, c))
    elif head.num_rows <= broadcast_queries:
        size = _common_dimension([len(v) for v in head["vec"]], dim)
        c = _vectors(chunks, chunk_id, vector, exclude, size)
        found = _scan_chunks(c, _result_schema(q, c), head, make, exclude is not None)
    else:
        span = q.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        c = _vectors(chunks, chunk_id, vector, exclude, _common_dimension(list(span), dim))
        if centres is None:
            centres = _fitted_centres(c, n_cells)
        indexed = assign_cells(c, "key", "vec", centres)
        index = build_cell_index(indexed, centres, block_rows)
        found = _block_join(
            _placed(q, index, min_similarity, None), indexed, _result_schema(q, c), make,
            None if exclude is None else _differ, query_block_rows,
        )
    return top_k(
        found.withColumnsRenamed({"query_key": query_id, "chunk_key": chunk_id}), query_id, chunk_id, k
    )


def count_above(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    min_similarity: float,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    exclude: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    n_cells: int = 64,
    block_rows: int = BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    centres: np.ndarray | None = None,
    dim: int | None = None,
) -> DataFrame:
    """(query_id, above): how many chunks lie strictly above the threshold, for queries that have any.

    Pairs are counted where their products are formed; a task hands on one number
    per query that it met. The physical forms are those of :func:`similarity_join`.
    """
    q = _vectors(queries, query_id, vector, exclude, None)
    head = q.limit(broadcast_queries + 1).toArrow()
    floor = _strictly_above(min_similarity)
    schema = T.StructType([T.StructField("query_key", _type_of(q, "key")), T.StructField("n", T.LongType())])

    def make(unit: np.ndarray, own: np.ndarray | None, related: Callable | None) -> _Counts:
        return _Counts(unit, own, related, floor, block_rows)

    if not head.num_rows:
        found = q.sparkSession.createDataFrame([], schema)
    elif head.num_rows <= broadcast_queries:
        c = _vectors(chunks, chunk_id, vector, exclude, _common_dimension([len(v) for v in head["vec"]], dim))
        found = _scan_chunks(c, schema, head, make, exclude is not None)
    else:
        span = q.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        c = _vectors(chunks, chunk_id, vector, exclude, _common_dimension(list(span), dim))
        if centres is None:
            centres = _fitted_centres(c, n_cells)
        indexed = assign_cells(c, "key", "vec", centres)
        index = build_cell_index(indexed, centres, block_rows)
        found = _block_join(
            _placed(q, index, min_similarity, None), indexed, schema, make,
            None if exclude is None else _differ, query_block_rows,
        )
    return found.groupBy(F.col("query_key").alias(query_id)).agg(F.sum("n").alias("above"))


def similarity_join_ivf(
    queries: DataFrame,
    indexed: DataFrame,
    index: CellIndex,
    *,
    k: int,
    min_similarity: float,
    n_probe: int = 4,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    query_block_rows: int = QUERY_BLOCK_ROWS,
) -> DataFrame:
    """Approximate top-k: every query meets the chunks of its ``n_probe`` nearest cells.

    ``indexed`` is the chunk table after :func:`assign_cells`.
    """
    dim = index.centres.shape[1]
    q = _vectors(queries, query_id, vector, None, dim)
    c = indexed.filter(F.size(vector) > 0).select(
        F.col(chunk_id).alias("key"),
        require_dimension(F.col(vector), dim).alias("vec"),
        F.lit(None).cast("string").alias("grp"),
        "cell",
    )
    found = _block_join(
        _placed(q, index, min_similarity, n_probe), c, _result_schema(q, c),
        _top_k_maker(k, min_similarity), None, query_block_rows,
    )
    return top_k(
        found.withColumnsRenamed({"query_key": query_id, "chunk_key": chunk_id}), query_id, chunk_id, k
    )


def similarity_join_lsh(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int,
    min_similarity: float,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 7,
    query_block_rows: int = QUERY_BLOCK_ROWS,
) -> DataFrame:
    """Approximate top-k with random-projection buckets on unit vectors.

    A pair counts if it shares a bucket in one of the ``tables``. Buckets are not
    groups of tasks, as a bucket may hold most of the rows: a product is formed
    once however many buckets two rows share, and only pairs that may be among
    the best are asked for a common bucket.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from citespark.functions.text import bind
    from citespark.functions.vectors import norm

    def unit(df: DataFrame, key: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        vec = bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))
        rows = df.select(F.col(key).alias("key"), F.inline_outer(F.array(F.struct(vec.alias("vec"))))).filter("vec IS NOT NULL")
        return rows.withColumn("features", array_to_vector("vec"))

    a, b = unit(queries, query_id), unit(chunks, chunk_id)
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=tables, seed=seed,
    ).fit(b)

    def hashed(df: DataFrame) -> DataFrame:
        # a table's hash is a vector of one number
        buckets = F.array(*[vector_to_array(F.get("hashes", F.lit(i)))[0].cast("long") for i in range(tables)])
        return model.transform(df).select("key", "vec", buckets.alias("grp"))

    one = F.lit(0).cast("int")
    a = hashed(a).withColumns({"home": one, "cells": F.array(one)})
    b = hashed(b).withColumn("cell", one)
    found = _block_join(
        a, b, _result_schema(a, b), _top_k_maker(k, min_similarity), _share, query_block_rows
    )
    return top_k(
        found.withColumnsRenamed({"query_key": query_id, "chunk_key": chunk_id}), query_id, chunk_id, k
    )


def paper_neighbours(
    papers: DataFrame,
    targets: DataFrame,
    *,
    limit: int = 5,
    min_similarity: float = 0.5,
    paper_id: str = "paper_id",
    vector: str = "embedding",
    **physical: int,
) -> DataFrame:
    """Papers most like each target paper, the paper itself left out."""
    key = F.col(paper_id)
    q = targets.select(key.alias("query_id"), key.alias("_self"), F.col(vector))
    c = papers.select(key.alias("neighbour_id"), key.alias("_self"), F.col(vector))
    return similarity_join(
        q, c, k=limit, min_similarity=min_similarity, chunk_id="neighbour_id", vector=vector,
        exclude="_self", **physical,
    ).withColumnRenamed("query_id", paper_id)


def search_sources(
    queries: DataFrame,
    sources: dict[str, DataFrame],
    *,
    per_source: int = 5,
    min_similarity: float = 0.5,
    **names: str,
) -> DataFrame:
    """Union of the best rows of several chunk tables; duplicates stay, source is named."""
    parts = [
        similarity_join(queries, table, k=per_source, min_similarity=min_similarity, **names)
        .drop("rank")
        .withColumn("source", F.lit(name))
        for name, table in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recall(exact: DataFrame, approximate: DataFrame, keys: list[str]) -> DataFrame:
    """Share of exact result rows an approximate join found."""
    hit = approximate.select(*keys).distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, keys, "left").agg(
        F.count("*").alias("expected"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )


def within_threshold(df: DataFrame, min_similarity: float, column: Column | str = "similarity") -> DataFrame:
    """Rows strictly above a similarity threshold."""
    return df.filter((F.col(column) if isinstance(column, str) else column) > min_similarity)
