"""Incremental ingest: new asset files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def asset_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_copies(stream: DataFrame, key: str = "sha256", time: str = "seen_at", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, group: str, time: str = "seen_at", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and bytes per group and tumbling window, given out when the watermark has passed the window."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), group)
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes all available rows and stops; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
