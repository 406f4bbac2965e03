"""Joins of asset tables with metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.operators.dedupe import first_row


def merge_metric(base: DataFrame, metric: DataFrame, key: str, *order: Column) -> DataFrame:
    """Left join of the metric's first row per key; columns that base has stay base's. Null keys match null keys."""
    fresh = metric.drop(*[c for c in metric.columns if c in base.columns and c != key])
    one = first_row(fresh, [key], *order) if order else fresh.dropDuplicates([key])
    side = one.withColumnRenamed(key, "_metric_key")
    return base.join(side, base[key].eqNullSafe(side["_metric_key"]), "left").drop("_metric_key")


def missing_ids(metric: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Metric rows whose key the index lacks; callers that need all keys raise if there are any."""
    return metric.join(index.select(key), key, "left_anti")


def orphans(files: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    return files.join(linked.select(key).distinct(), key, "left_anti")


def linked(files: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return files.join(links.select(key), key, "left_semi")


def enrich_pairs(pairs: DataFrame, assets: DataFrame, key: str, columns: list[str], ends: tuple[str, str] = ("img1", "img2")) -> DataFrame:
    """Pairs with the columns of both ends' assets, suffixed _1 and _2."""
    for n, end in enumerate(ends, 1):
        side = assets.dropDuplicates([key]).select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{n}") for c in columns])
        pairs = pairs.join(side, end, "left")
    return pairs


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the new row stands."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def sidecars_of(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media (folder, name, stem) with the sidecar of their name, else of their stem: two equi-joins."""
    by = sidecars.select("folder", F.col("name").alias("s_name"), "path")
    full = by.select("folder", F.col("s_name").alias("n1"), F.col("path").alias("p1"))
    short = by.select("folder", F.col("s_name").alias("n2"), F.col("path").alias("p2"))
    found = media.withColumn("n1", F.concat("name", F.lit(".json"))).withColumn("n2", F.concat("stem", F.lit(".json")))
    return found.join(full, ["folder", "n1"], "left").join(short, ["folder", "n2"], "left").withColumn("json_path", F.coalesce("p1", "p2")).drop("n1", "n2", "p1", "p2")
