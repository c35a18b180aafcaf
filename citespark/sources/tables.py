"""Table scans with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, partitions: int | None = None
) -> DataFrame:
    """A Parquet table; filters and column choices reach the scan.

    ``partitions`` deals the rows out anew, for CPU-heavy work on a table stored in
    fewer row groups than there are cores; it costs a shuffle, so leave it out for large tables.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    return table if partitions is None else table.repartition(partitions)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), **options,
    )
    return reader.load()
