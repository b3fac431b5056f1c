"""Duplicate sources: by normalised content, and survivors of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import one_line


def content_hashes(chunks: DataFrame) -> DataFrame:
    """(id, hash): SHA-256 of a source's chunks in order, white space as one blank, nothing between."""
    parts = chunks.select("id", F.struct("position", one_line(F.col("content")).alias("content")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["content"]), "")
    return parts.groupBy("id").agg(F.sha2(joined, 256).alias("hash"))


def exact_groups(hashes: DataFrame) -> DataFrame:
    """(hash, size, oldest) of groups of two or more, of sources (id, hash, created_at)."""
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("created_at", "id")).alias("o")).filter("size >= 2").select("hash", "size", F.col("o.id").alias("oldest"))


def survivors(hashes: DataFrame) -> DataFrame:
    """The oldest source of each hash: a partial minimum, not a window over a group."""
    return hashes.groupBy("hash").agg(F.min(F.struct("created_at", "id")).alias("o")).select(F.col("o.id").alias("id"), "hash")
