"""Incremental indexing as a stream: chunk files that arrive in a folder, windowed counts of late rows, upserts by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(rows: DataFrame, key: str = "chunk_id", at: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """Each key once, whatever file repeats it within the watermark."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def late_counts(rows: DataFrame, at: str = "ingested_at", window: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """(window, document_id, n) of rows by the time they were taken in."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, window), "document_id").agg(F.count("*").alias("n"))


def upserting(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``write`` on every batch of what is there now and stops; the checkpoint makes a restart go on after it."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
