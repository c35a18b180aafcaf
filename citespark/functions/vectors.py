"""Vector expressions in double precision for pairs that are already joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL for a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def require_dimension(vector: Column, dim: int) -> Column:
    """The vector itself, or an error that names the wrong size."""
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message))


def split_by_dimension(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors of ``dim`` elements, and the rejected rest with a reason."""
    fits = F.coalesce(F.size(F.col(vector)) == dim, F.lit(False))
    size = F.coalesce(F.size(F.col(vector)).cast("string"), F.lit("no vector"))
    rejects = df.filter(~fits).withColumn(
        "reason", F.concat(F.lit(f"expected {dim} dimensions, got "), size)
    )
    return df.filter(fits), rejects
