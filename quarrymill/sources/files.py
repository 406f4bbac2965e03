"""File listings, sidecars and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarrymill.functions import coerce, names

AUDIT = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.StringType())])
RAW_FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("extension", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("created_at_fs", T.DoubleType()), T.StructField("file_role", T.StringType()), T.StructField("inferred_asset_type", T.StringType()), T.StructField("album_path", T.StringType())])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of every file below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "modificationTime", "length")


def raw_files(files: DataFrame, root: str) -> DataFrame:
    """One typed row per listed file."""
    path = F.regexp_replace("path", r"^file:/*", "/")
    role = names.file_role(path)
    kind = F.when(role == "media/photo", "photo").when(role == "media/video", "video").otherwise("")
    return files.select(path.alias("file_path"), names.file_name(path).alias("file_name"), names.suffix(path).alias("extension"), F.col("length").alias("file_size"), F.col("modificationTime").cast("double").alias("created_at_fs"), role.alias("file_role"), kind.alias("inferred_asset_type"), names.album(path, root).alias("album_path"))


def archives(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_role") == "archive")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, json_datetime) of the JSON files below ``root``; malformed ones have null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), coerce.json_datetime(F.col("content").cast("string")).alias("json_datetime"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with header, quotes doubled inside quotes, maybe a BOM; types are given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def uncached(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose features aren't yet in the cache table."""
    return work.join(cache.select(key), key, "left_anti")


def cache_key(path: Column, size: Column, modified: Column, model: str) -> Column:
    return F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), F.lit(model)).cast("binary"))
