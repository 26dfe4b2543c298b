"""Structured Streaming forms: the text functions run unchanged on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamwork.functions import text as T


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_stream(docs: DataFrame) -> DataFrame:
    """Cleaned documents with their checks; stateless, so it works on batches and streams alike."""
    cleaned = T.regex_clean(F.col("text"))
    return docs.withColumn("cleaned", cleaned).withColumn("checks", T.verify(F.col("text"), cleaned))


def event_windows(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; events later than ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
