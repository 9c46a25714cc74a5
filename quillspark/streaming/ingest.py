"""Incremental ingestion of a landing folder: each content once, counts as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once_per_content(stream: DataFrame, text: str, time: str, delay: str = "1 day") -> DataFrame:
    """First arrival of each content inside the watermark; state is dropped behind it."""
    return stream.withWatermark(time, delay).withColumn("hash_sha256", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["hash_sha256"])


def counts_by_window(stream: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
