"""Tables that streams maintain: one folder per batch, repeatable writes.

``<path>/batch=<n>`` holds what batch n wrote. A repeated batch overwrites its
own folder and reads only folders of earlier batches.

A :class:`KeyedTable` keeps the current row of each key: batches write only the
rows that they change, readers merge them, compaction rewrites touched buckets.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a local one of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tables-{spark._jvm.java.util.UUID.randomUUID()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tables-")


def _folders(spark: SparkSession, path: str, prefix: str = "batch") -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{prefix}=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in numbers if fs.exists(done(f"{path}/{prefix}={n}/_SUCCESS")))


def read_before(
    spark: SparkSession, path: str, batch_id: int | None, schema: T.StructType | str
) -> DataFrame:
    """Rows of all finished batches before ``batch_id`` (all of them for None), with ``batch``."""
    done = [n for n in _folders(spark, path) if batch_id is None or n < batch_id]
    if not done:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return (
        spark.read.schema(schema)
        .option("basePath", path)
        .parquet(*[f"{path}/batch={n}" for n in done])
    )


def read_latest(
    spark: SparkSession, path: str, batch_id: int | None, schema: T.StructType | str
) -> DataFrame:
    """The snapshot the last finished batch before ``batch_id`` wrote."""
    done = [n for n in _folders(spark, path) if batch_id is None or n < batch_id]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={done[-1]}")


@dataclass
class KeyedTable:
    """The newest row of each key, as written buckets and the changes since.

    ``<path>/delta=<n>`` holds the rows that batch n changed, one per key.
    ``<path>/base=<n>`` holds, after compaction, the rows of all batches up to n,
    but only of buckets that changed since the base before; the newest folder of a
    bucket counts. What a batch writes follows its changes, not the table, and a
    reader that names buckets opens no other. Keys are not NULL. A repeated batch
    overwrites its own delta and sees only what came before it.
    """

    spark: SparkSession
    path: str
    schema: T.StructType | str
    keys: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self) -> None:
        if isinstance(self.schema, str):
            self.schema = T.StructType.fromDDL(self.schema)

    def bucket(self, *keys: Column | str) -> Column:
        """The bucket of a row, from the key columns or the ones given in their place."""
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of these rows, as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def seed(self, rows: DataFrame) -> None:
        """The table as it was before batch 0."""
        self._write_base(rows, -1)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        rows = changes.select(*self._columns()).withColumn("bucket", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta={batch_id}")

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, or those before a batch; of some buckets only if they are named."""
        bases, deltas = self._state(before)
        old = self._load([f"base={n}/bucket={b}" for b, n in sorted(bases.items()) if buckets is None or b in buckets], "base")
        if not deltas:
            return old.select(*self._columns())
        new = self._load([f"delta={n}" for n in deltas], "delta")
        if buckets is not None:
            new = new.filter(F.col("bucket").isin(buckets))
        newest = new.groupBy(*self.keys).agg(F.max_by(F.struct(*self._columns()), "delta").alias("row")).select("row.*")
        kept = old.join(newest.select(*self.keys), list(self.keys), "left_anti")
        return kept.select(*self._columns()).unionByName(newest)

    def compact(self, before: int, after: int = 8) -> bool:
        """Before batch ``before``, ``after`` or more deltas are merged into their buckets; tells whether they were."""
        _, deltas = self._state(before)
        if len(deltas) < max(1, after):
            return False
        touched = sorted({b for n in deltas for b in self._buckets_in(f"delta={n}")})
        self._write_base(self.read(before, touched), deltas[-1])
        return True

    def _columns(self) -> list[str]:
        return self.schema.fieldNames()

    def _state(self, before: int | None) -> tuple[dict[int, int], list[int]]:
        """Base folder of each bucket, and the deltas after the last base."""
        earlier = lambda kind: [n for n in _folders(self.spark, self.path, kind) if before is None or n < before]
        numbers = earlier("base")
        bases = {b: n for n in numbers for b in self._buckets_in(f"base={n}")}
        return bases, [n for n in earlier("delta") if not numbers or n > numbers[-1]]

    def _buckets_in(self, folder: str) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return [int(n.split("=", 1)[1]) for n in names if n.startswith("bucket=")]

    def _write_base(self, rows: DataFrame, number: int) -> None:
        rows = rows.select(*self._columns()).withColumn("bucket", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base={number}")

    def _load(self, folders: list[str], kind: str) -> DataFrame:
        extra = [T.StructField("bucket", T.IntegerType()), T.StructField(kind, T.IntegerType())]
        schema = T.StructType([*self.schema.fields, *extra])
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])
