"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """``"a long, b array<double>"`` as an Arrow schema."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (part.split() for part in ddl.split(","))])


#: Edges in one task of a round of connected components.
EDGE_ROWS = 100_000
#: Labelled documents in one task.
SAMPLE_ROWS = 1_000


#: Rows in an Arrow batch between Spark and Python; whole texts make batches of the default size too large.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS``, so that workers hold few whole texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_rows(df: DataFrame, ddl: str, make: Callable[[], Callable[..., list]], rows: int = 256) -> DataFrame:
    """Rows from rows inside the tasks, without a shuffle.

    ``make()`` runs once per task and returns a function from the columns of a
    slice (Python lists) to the output columns (lists or arrays of any length).
    Slices hold ``rows`` rows, so memory is bounded by the slice.
    """

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, schema = make(), arrow_schema(ddl)
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                columns = work(*(c.to_pylist() for c in batch.slice(low, rows).columns))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)


def text_udf(ddl: str, make: Callable[[], Callable[[list], list]], rows: int = 256) -> Callable[[Column], Column]:
    """A column from a text column in Arrow batches; ``make()`` runs once per task. NULL reaches the function as ''.

    The function takes a list of texts and returns a list of values, or a dict of
    lists if ``ddl`` is a struct of several fields.
    """
    bound_batches(SparkSession.active())
    struct = ddl.startswith("struct<")

    def slices(series: pd.Series) -> Iterator[list]:
        for low in range(0, len(series), rows):
            yield [t if isinstance(t, str) else "" for t in series.iloc[low : low + rows]]

    if struct:

        @F.pandas_udf(ddl)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            work = make()
            for series in parts:
                found = [pd.DataFrame(work(texts)) for texts in slices(series)]
                yield pd.concat(found, ignore_index=True) if found else pd.DataFrame(work([]))
    else:

        @F.pandas_udf(ddl)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            work = make()
            for series in parts:
                yield pd.Series([v for texts in slices(series) for v in work(texts)], dtype=object)

    return run


def id_crc(column: Column) -> Column:
    """crc32 of an id as text; NULL counts as ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's folder; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the shared checkpoint folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A written table in as few partitions as hold about ``rows`` rows each, and its number of rows.

    Python tasks cost a start each, so small tables should not run in as many as large ones.
    """
    n = df.count()
    return df.coalesce(max(1, -(-n // rows))), n


def usable_vector(v: Column) -> Column:
    """True for vectors that are neither null nor zero and have finite components only, else False."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random order of long ids, another one for every seed (64-bit finalising mixer)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def forest(left: np.ndarray, right: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges and for each the root of its tree: its first node in the order of ``mixed``."""
    nodes = np.unique(np.concatenate([left, right]))
    nodes = nodes[np.argsort(mixed(nodes, seed), kind="stable")]
    back = np.argsort(nodes)
    place = lambda x: back[np.searchsorted(nodes, x, sorter=back)].tolist()
    parent = list(range(len(nodes)))
    for a, b in zip(place(left), place(right)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    root = np.arange(len(nodes))
    for i, p in enumerate(parent):  # a parent comes no later, so it is final already
        root[i] = root[p]
    return nodes, nodes[root]


def _stars(edges: DataFrame, seed: int) -> DataFrame:
    """(node, root, turn) from (a, b): every batch of edges becomes stars, at most one row per node and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, roots = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy(), seed)
                columns = [pa.array(nodes), pa.array(roots), pa.array(mixed(roots, seed))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "turn"])

    return edges.select("a", "b").mapInArrow(run, "node long, root long, turn long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long): the smallest node that links reach.

    Each round turns batches of edges into stars, maps every node to the first of
    its roots in a pseudo-random order (an aggregate that combines before the
    shuffle) and keeps only the edges between a node's roots. Nodes that are no
    root drop out, so the expected size falls by a constant factor, whatever the
    shape of the graph; then the maps are applied from the last to the first. No
    component is ever gathered in one task or on the driver.
    """
    maps = []
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    left = checkpoint(left.filter("a IS NOT NULL AND b IS NOT NULL"))
    while True:
        left, n = compact(left, EDGE_ROWS)
        if not n:
            break
        stars = checkpoint(_stars(left, len(maps)))
        first = checkpoint(stars.groupBy("node").agg(F.min_by("root", "turn").alias("to")))
        maps.append(first)
        linked = stars.join(first, "node").filter("root != to")
        left = checkpoint(linked.select(F.col("root").alias("a"), F.col("to").alias("b")))
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("_last"))
        found = checkpoint(earlier.join(later, "to", "left").select("node", F.coalesce("_last", "to").alias("to")))
    smallest = checkpoint(found.groupBy("to").agg(F.min("node").alias("component")))
    return found.join(smallest, "to").select("node", "component")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, chosen by a hash of the id.

    ``keep`` says which rows of ``labels`` may be learned from; an id with both
    labels counts as 1. Only the bounded list of ids is broadcast, documents are
    not shuffled. Repeated ids take part as often as they occur, up to twice the bound.
    """
    known = labels.filter(keep & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return compact(checkpoint(sample), SAMPLE_ROWS)[0]
