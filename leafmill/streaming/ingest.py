"""Structured Streaming: documents that arrive in a folder become table rows, and late events are counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import documents


def document_stream(spark: SparkSession, folder: str, name: str, most: int = 1000) -> DataFrame:
    """The table ``name`` of documents as they arrive; a stream with the batch loader's rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most).load(folder)
    return documents.load(files.select(F.col("path").alias("doc_id"), "content"), name)


def event_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by type and window; rows later than ``delay`` don't count, and repeated ids count once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
