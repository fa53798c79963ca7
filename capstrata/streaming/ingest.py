"""Structured Streaming: counts over an event stream, and filings extracted as they arrive."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_events
from ..session import checkpoint_dir, table


def counted_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """Reads a table's file as a stream, keeps counts per event type, and returns them once all is read."""
    schema = table(spark, sf_dir, name).schema
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    counts = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_filings(spark: SparkSession, folder: str, out: str, state: str):
    """Markdown files that appear in a folder are extracted once each and appended to a table of events.

    Returns the running query; the state folder makes a restart go on where it stopped.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.m*d*").load(folder)
    named = files.select(F.col("_metadata.file_name").alias("filing_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch, so a batch that is run again replaces what it wrote.
        extract_events(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return named.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event counts per time window and type of a stream or a table, with late rows admitted up to ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
