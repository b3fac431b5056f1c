"""Vectors as arrays: cosine, norm and means, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where sizes differ or a vector is zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, mean) in long form: partial sums are kept for each dimension, never a group of vectors."""
    cells = rows.select(key, F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
