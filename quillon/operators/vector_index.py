"""A stored inverted file of vectors: lists around k-means centroids, searched from the nearest list on, or exactly.

Rows lie in folders by the list that they are nearest to. A search routes each query to a few lists and reads those alone. As
the index knows how far each list's rows reach from its centroid, it can also tell which other lists may hold one of the best
k: an exact search reads them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.pruned import matrix
from quillon.operators.search import ROW_BLOCK, nearest
from quillon.sources.store import written

#: Lists at most, and rows of the sample for each list that centroids are fitted on.
LISTS, PER_LIST = 1024, 32
PROBES = 8


def centroids(rows: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by k-means on ``lists`` * PER_LIST rows (id, vector) at most, chosen by a hash."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(lists * PER_LIST).select("vector").toArrow()
    units = matrix(some["vector"], len(some))
    centre = units[:lists].copy()
    for _ in range(rounds):
        near = np.concatenate([(units[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(units), 4096)])
        for k in np.unique(near):
            total = units[near == k].sum(0)
            centre[k] = total / (np.linalg.norm(total) or 1.0)
    return centre


class VectorIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, rows: DataFrame, lists: int | None = None) -> VectorIndex:
        """An index of rows (id, vector): about as many lists as the root of the rows, LISTS at most."""
        lists = lists or max(1, min(LISTS, round(rows.count() ** 0.5)))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids(rows, lists))], "list int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/centroids")
        return self.add(rows)

    def add(self, rows: DataFrame) -> VectorIndex:
        """More rows, in lists around the same centroids; null vectors are left out."""
        shared, kind = self._centroids(), dict(rows.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cosine = matrix(batch.column("vector"), len(batch)) @ shared.value.T
                    near = cosine.argmax(1)
                    yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(cosine[np.arange(len(batch)), near])], ["id", "vector", "list", "near"])

        placed = rows.filter("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"id {kind}, vector array<double>, list int, near double")
        # A list of very many rows spans several files.
        spread = F.pmod(F.xxhash64("id"), F.lit(64))
        placed.repartition("list", spread).sortWithinPartitions("list").write.mode("append").partitionBy("list").parquet(f"{self.root}/rows")
        return self

    def _centroids(self):
        table = self.spark.read.parquet(f"{self.root}/centroids").orderBy("list").toArrow()  # LISTS rows at most
        return self.spark.sparkContext.broadcast(np.stack(table["centre"].to_numpy(zero_copy_only=False)))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def lists(self) -> DataFrame:
        """(list, n, reach): rows of each list, and the least cosine of one to its centroid."""
        return self.rows().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("reach"))

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k rows of largest cosine, ties by id, in the ``probes`` nearest lists of each query (id,
        vector); ``exact``: of all rows, from the lists that bounds can't leave out.
        """
        known = {r["list"]: (r.n, r.reach) for r in self.lists().collect()}  # LISTS rows at most
        queries = written(queries.filter("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector")), "queries")
        routed = written(self._route(queries.withColumn("least", F.lit(None).cast("double")), known, probes), "routes")
        found = written(self._meet(queries, routed, known, k), "found")
        if exact:
            # What a query's k-th best is so far; a query with fewer looks everywhere.
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            least = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            asked = queries.join(least, "id", "left").select("id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
            more = self._route(asked, known, probes).join(routed, ["id", "list"], "left_anti")
            found = found.unionByName(self._meet(queries, written(more, "routes"), known, k))
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    def _route(self, queries: DataFrame, known: dict[int, tuple[int, float]], probes: int) -> DataFrame:
        """(id, list): the nearest lists of queries (id, vector, least), or, if ``least`` is known, all that may hold a row so close."""
        shared, names = self._centroids(), np.array(sorted(known), np.int64)
        reach = np.array([known[i][1] for i in names.tolist()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                cosine = matrix(batch.column("vector"), len(batch)) @ shared.value[names].T
                if batch.column("least").null_count:
                    order = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
                    row, which = np.repeat(np.arange(len(batch)), order.shape[1]), order.ravel()
                else:
                    # No row of a list is nearer to the query than the angle to its centroid less the list's reach.
                    angle = np.arccos(cosine.clip(-1, 1)) - np.arccos(reach.clip(-1, 1))[None, :]
                    row, which = np.nonzero(np.cos(angle.clip(0)) >= np.asarray(batch.column("least"))[:, None] - 1e-6)
                yield pa.record_batch([batch.column("id").take(pa.array(row)), pa.array(names[which])], ["id", "list"])

        return queries.mapInArrow(run, f"id {dict(queries.dtypes)['id']}, list bigint")

    def _meet(self, queries: DataFrame, routed: DataFrame, known: dict[int, tuple[int, float]], k: int) -> DataFrame:
        """(query_id, id, score): the best k rows of each part of a list for the queries that are routed to it."""
        wanted = sorted(r["list"] for r in routed.select("list").distinct().collect())  # LISTS rows at most
        parts = F.create_map(*[F.lit(x) for i in wanted for x in (i, -(-known[i][0] // ROW_BLOCK))])
        if not wanted:
            return self.spark.createDataFrame([], "query_id bigint, id bigint, score double")
        rows = self.rows().filter(F.col("list").isin(wanted)).withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("list").cast("bigint")]))
        rows = rows.select("id", "vector", F.col("list").cast("bigint").alias("list"), F.col("part").cast("bigint").alias("part"))
        asked = queries.join(routed, "id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts[F.col("list")].cast("bigint") - 1)))
        return rows.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(nearest(k), "query_id bigint, id bigint, score double")
