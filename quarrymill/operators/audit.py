"""Metric and value tables about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymill.operators.joins import upsert


def file_counts(files: DataFrame, role: str = "file_role") -> DataFrame:
    """(metric, value): the number of files, and of each role."""
    roles = files.groupBy(role).agg(F.count(F.lit(1)).alias("n"))
    total = files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_files").alias("metric"), F.col("n").cast("string").alias("value"))
    return total.union(roles.select(F.concat(F.lit("files_"), F.col(role)).alias("metric"), F.col("n").cast("string").alias("value")))


def merge(new: DataFrame, old: DataFrame) -> DataFrame:
    """Both reports; a metric of the new one replaces the old one's."""
    return upsert(new, old, "metric")
