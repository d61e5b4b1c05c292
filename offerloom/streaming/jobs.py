"""Structured Streaming forms of the periodic jobs. Each run takes what is there and stops
(``availableNow``), so a scheduler starts it; results equal the batch operators'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(items: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the time that late rows may take, the streaming form of the unique key."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_metrics(events: DataFrame, at: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per source and window; a window is final once late rows can no longer come."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors")).select(F.col("w.start").alias("start"), "source", "n", "errors")


def upsert_into(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``apply(batch, epoch)``; a batch that is retried has its epoch
    again, so writers that key on it write once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
