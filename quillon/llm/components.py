"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Hang neighbours on the smallest node of their neighbourhood: the larger ones, or all of the smaller ones."""
    around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    low = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hung = around.join(low, "a")
    if both:
        hung = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return hung.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that it is connected to.

    Each round joins links with one pre-aggregated row for each node, so a node with very many links is
    split like any skewed join. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    before = None
    while True:
        edges = written(_stars(_stars(edges, both=True), both=False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
