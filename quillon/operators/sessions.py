"""Conversations, incremental ingest and change streams as batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """System messages and the last 2 * turns others of each conversation (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(order)).filter((F.col("role") == "system") | (F.col("_n") <= 2 * turns)).drop("_n")


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered source blocks in rank order, of ranked hits (query_id, rank, title, content)."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("title"), F.lit("\n"), F.col("content"))
    rows = hits.select("query_id", F.struct("rank", block.alias("block")).alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n")
    return rows.groupBy("query_id").agg(text.alias("context"))


def ingest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(origin, status) with status new, changed, same or gone, of states (origin, hash)."""
    both = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), "origin", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    return both.select("origin", status.alias("status"))


def debounce(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """One event for each burst of a path (path, ts, type): bursts end after ``gap`` of quiet, the last type wins."""
    burst = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("type", F.struct("ts", "seq")).alias("type"), F.max("ts").alias("last_ts"))
    return burst.select("path", "n", "type", "last_ts")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) with created, modified or deleted, of snapshots (path, mtime, size)."""
    both = before.select("path", F.struct("mtime", "size").alias("x")).join(after.select("path", F.struct("mtime", "size").alias("y")), "path", "full_outer")
    change = F.when(F.col("x").isNull(), "created").when(F.col("y").isNull(), "deleted").when(F.col("x") != F.col("y"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys aren't among them."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def sync_action(local_hash, remote_hash, local_time, remote_time):
    """push, pull or none: by presence, then hash, then time."""
    return (
        F.when(local_hash.isNull() & remote_hash.isNull(), "none").when(remote_hash.isNull(), "push").when(local_hash.isNull(), "pull")
        .when(local_hash == remote_hash, "none").when(local_time > remote_time, "push").otherwise("pull")
    )
