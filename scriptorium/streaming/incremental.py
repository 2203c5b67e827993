"""Incremental ingest by Structured Streaming: an extension to the batch build.

Micro-batches are merged into a table of current rows by key; a content hash
keeps rows that haven't changed from being worked on again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions.text import content_key
from scriptorium.operators.joins import last_wins


def new_or_changed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, text) whose id and content aren't known (id, key), with their key."""
    keyed = rows.withColumn("key", content_key(F.col("text")))
    return keyed.join(known.select("id", "key"), ["id", "key"], "left_anti")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps under path/version=N the latest text of each id (id, text, ord); the newest version is the table.

    A version is written whole before it counts, and one that a failed batch left is overwritten."""

    def merge(batch: DataFrame, number: int) -> None:
        now = batch.select("id", "text", "ord")
        if number > 0:
            now = batch.sparkSession.read.parquet(f"{path}/version={number - 1}").unionByName(now)
        last_wins(now, ["id"], ["ord"]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """kind, start, n of events (ts, kind) in windows of event time; later events than the watermark are dropped in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.col("w.start").alias("start"), "n")


def read_growing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
