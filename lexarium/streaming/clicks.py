"""Streams: click counts by window and query, and documents that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import index
from lexarium.sources.files import click


def click_lines(spark: SparkSession, path: str) -> DataFrame:
    """Clicks of log files as they arrive."""
    return spark.readStream.text(path).select(click(F.col("value")).alias("c")).where("c.doc_id IS NOT NULL").select("c.*")


def windowed(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and mean value by window and type; what comes later than `late` is left out, and state is dropped after it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def incremental_index(spark: SparkSession, path: str, schema: str, write: Callable[[DataFrame, int], None]) -> DataFrame:
    """Documents (doc_id, text) that arrive as Parquet; `write` gets the postings of each batch and its number, and must overwrite by number."""
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.writeStream.foreachBatch(lambda batch, n: write(index.postings(index.tokens(batch)), n))
