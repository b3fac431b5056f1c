"""Structured Streaming: event-time windows and idempotent ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_windows(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, for a table or, with a watermark, a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a stream of updates over all that is there now and return its rows: of each key what the last batch said.

    A batch is written under its number, so one that comes again after a restart writes the same files anew.
    """
    spark, schema = stream.sparkSession, stream.schema
    out = f"{folder}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/_batch={number}")

    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, _batch int").parquet(f"{out}/rows/*")
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("last")).select(*keys, "last.*").select(*schema.names)


def run_appended(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream whose rows are final over all that is there now, and return them; ``folder`` keeps rows and state, so a later run goes on."""
    query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/rows").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files under a path, or the one file that it is, as a stream with the table's schema."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern, as Spark takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
