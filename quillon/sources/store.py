"""Knowledge-base tables as plain Parquet folders, partitioned by collection, and where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.sessions import upsert


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a single local process without one gets a fresh folder, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of a job that ends within: its result is written, so that nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: a cut lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quillon-{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KnowledgeBase:
    """A folder with one sub-folder for each table. Rows with a collection lie in partitions by it.

    Inserts append. Other changes replace the partitions that they touch, from a staged result, by Spark's dynamic
    partition overwrite; each of them can be run again after a failure with the same outcome.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, collection: str | None = None) -> DataFrame:
        """A table; of one collection if that is named and not empty."""
        rows = self.spark.read.parquet(self.path(name))
        return rows.filter(F.col("collection") == collection) if collection else rows

    def has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return False
        return True

    def append(self, name: str, rows: DataFrame) -> None:
        """Insert rows: one job, whose files appear when it commits."""
        self._writer(rows).mode("append").parquet(self.path(name))

    def _writer(self, rows: DataFrame):
        return rows.write.partitionBy("collection") if "collection" in rows.columns else rows.write

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a whole table."""
        self._writer(written(rows, name)).mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(name))

    def _replace(self, name: str, changed: DataFrame, touched: DataFrame) -> None:
        """Replace the partitions of the collections in ``touched`` by those rows of ``changed``, which is the table after a change."""
        if "collection" not in changed.columns:
            return self.overwrite(name, changed)
        names = written(touched.select("collection").distinct(), "touched")
        staged = written(changed.join(names, "collection", "left_semi"), name)
        if not names.join(staged.select("collection").distinct(), "collection", "left_anti").isEmpty():
            return self.overwrite(name, changed)  # a collection lost its last row, and with it its partition
        self._writer(staged).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        if not self.has(name):
            return self.append(name, rows)
        old = self.read(name)
        touched = rows if "collection" not in rows.columns else rows.select("collection").unionByName(old.join(rows.select(*keys), keys, "left_semi").select("collection"))
        self._replace(name, upsert(old, rows.select(*old.columns), keys), touched)

    def delete(self, name: str, ids: DataFrame, keys: list[str]) -> None:
        old, gone = self.read(name), ids.select(*keys).distinct()
        self._replace(name, old.join(gone, keys, "left_anti"), old.join(gone, keys, "left_semi"))

    def update_hash(self, ids: DataFrame) -> None:
        """Sources in ``ids`` (id, origin_hash) get a new hash."""
        old = self.read("sources")
        new = old.drop("origin_hash").join(ids.select("id", "origin_hash"), "id").select(*old.columns)
        self.upsert("sources", new, ["id"])

    def delete_source(self, ids: DataFrame) -> None:
        """A source goes with its chunks and their embeddings, and relations at either end.

        What hangs on a source goes before it does, so a run that fails half-way can be repeated.
        """
        gone = written(ids.select("id").distinct(), "gone")
        chunks = written(self.read("chunks").join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("id").alias("chunk_id")), "chunk-ids")
        self.delete("embeddings", chunks, ["chunk_id"])
        self.delete("chunks", gone.withColumnRenamed("id", "source_id"), ["source_id"])
        for end in ("from_id", "to_id"):
            self.delete("relations", gone.withColumnRenamed("id", end), [end])
        self.delete("sources", gone, ["id"])

    def remove(self, origins: DataFrame) -> None:
        """Sources go by their origins; origins that no source has change nothing."""
        self.delete_source(self.read("sources").join(origins.select("origin"), "origin", "left_semi").select("id"))

    def remove_duplicates(self, groups: DataFrame, dry_run: bool = True) -> dict[str, int]:
        """What groups (kind, id, keep_id) of a run come to, and without ``dry_run`` the removal of all but the oldest of each."""
        groups = written(groups.select("kind", "id", "keep_id"), "groups")
        gone = groups.filter("id != keep_id").select("id")
        counts = {r.kind: r.n for r in groups.groupBy("kind").agg(F.countDistinct("keep_id").alias("n")).collect()}  # a row for each kind
        told = {"examined": self.read("sources").count(), "exact": counts.get("exact", 0), "near": counts.get("near", 0), "removed": 0 if dry_run else gone.count()}
        if told["removed"]:
            self.delete_source(gone)
        return told

    def delete_collection(self, name: str, force: bool = False) -> None:
        """A collection goes; one that still has sources only if forced, with all of them."""
        rows = self.read("sources", name)
        if not force and not rows.isEmpty():
            raise ValueError(f"collection {name} has sources")
        self.delete_source(rows)
        if self.has("collections"):
            self.delete("collections", self.read("collections").filter(F.col("name") == name), ["name"])
