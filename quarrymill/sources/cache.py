"""Results kept by key in a table, so that only new rows are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.storage import exists, stored
from quarrymill.sources.files import uncached


def kept(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """The cache table at ``path``, one row a key; empty if there is none yet. ``kind`` is its schema, with cache_key."""
    spark = rows.sparkSession
    table = spark.read.schema(kind).parquet(path) if exists(spark, path) else spark.createDataFrame([], kind)
    return table.dropDuplicates(["cache_key"])


def with_cache(rows: DataFrame, path: str, kind: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (with cache_key) and the columns of ``kind``: from the cache, else computed and added to it.

    ``compute`` gets the rows of new keys, once a key, and returns a table of
    ``kind``.  Rows with a null key are computed, but not kept.
    """
    known = kept(rows, path, kind)
    new = uncached(rows.where("cache_key IS NOT NULL"), known).dropDuplicates(["cache_key"])
    fresh = stored(compute(new).select(known.columns), "computed")
    fresh.write.mode("append").parquet(path)
    alone = rows.where("cache_key IS NULL")
    one = stored(alone.withColumn("_at", F.monotonically_increasing_id()), "keyless")
    computed = compute(one.withColumn("cache_key", F.col("_at").cast("string"))).select(known.columns)
    keyed = rows.where("cache_key IS NOT NULL").join(known.unionByName(fresh), "cache_key", "left")
    unkeyed = one.drop("cache_key").withColumn("cache_key", F.col("_at").cast("string")).join(computed, "cache_key", "left").drop("_at").withColumn("cache_key", F.lit(None).cast("string"))
    return keyed.unionByName(unkeyed)
