"""Folding exact copies into one canonical asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Columns of the canonical order beside size and path, best first.
RANK = ("has_sidecar", "sidecar_count", "has_json_time", "has_exif_time")
#: Fixed value: what the report says of a copy.
ABSORBED = "absorbed_into_canonical"


def _key(path: str) -> Column:
    """Ascending canonical order as one comparable struct: the least row survives."""
    return F.struct(*[(-F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in (*RANK, "file_size")], F.col(path).alias("path"))


def _keyed(assets: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows with ``_key``: the content's hash, or their own id where that is null."""
    return assets.withColumn("_key", F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(id_col).cast("string"))))


def united_sidecars(keyed: DataFrame, path: str) -> DataFrame:
    """(_key, sidecars): the different trimmed sidecar paths of each key in the order of their first file.

    Sidecars are folded as rows first, so what is gathered per key is only its
    different paths, however many copies there are.
    """
    each = keyed.select("_key", F.col(path).alias("_path"), F.posexplode("sidecars").alias("_at", "_side")).withColumn("_side", F.trim("_side")).where("_side <> ''")
    first = each.groupBy("_key", "_side").agg(F.min(F.struct("_path", "_at")).alias("_o"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_side").alias("s"))))
    return first.groupBy("_key").agg(F.transform(ordered, lambda x: x["s"]).alias("sidecars"))


def fold_copies(assets: DataFrame, key: str = "sha256", id_col: str = "asset_id", path: str = "path") -> DataFrame:
    """One row per different ``key``; rows with a null key are never copies and stand alone.

    (key, id, copies, has_sidecar, sidecar_count, sidecars, json_path,
    content_type, json_datetime, exif_datetime): the survivor of the canonical
    order; sidecars united in order of path, counted after that; the first
    non-empty json_path, else the first sidecar; the most frequent content type,
    of equals the first seen; the first non-empty times.  All folding is partial
    aggregation, so a value that most rows share isn't gathered in one task.
    """
    keyed = _keyed(assets, key, id_col)
    first = lambda c: F.min(F.when(F.trim(c) != "", F.struct(F.col(path).alias("o"), F.col(c).alias("v"))))["v"]
    given = [c for c in ("json_datetime", "exif_datetime", "json_path") if c in assets.columns]
    best = keyed.groupBy("_key").agg(
        F.min_by(F.struct(F.col(key).alias("key"), F.col(id_col).alias("id")), _key(path)).alias("s"),
        F.count(F.lit(1)).alias("copies"), *[first(c).alias(c) for c in given],
    )
    joined = best.join(united_sidecars(keyed, path), "_key", "left").join(first_mode(keyed, "_key", "content_type", path), "_key", "left")
    sides = F.coalesce("sidecars", F.array().cast("array<string>"))
    known = lambda c: F.col(c) if c in given else F.lit(None).cast("string")
    return joined.select(
        F.col("s.key").alias(key), F.col("s.id").alias(id_col), "copies", (F.size(sides) > 0).alias("has_sidecar"), F.size(sides).alias("sidecar_count"), sides.alias("sidecars"),
        F.coalesce(known("json_path"), F.get(sides, F.lit(0)), F.lit("")).alias("json_path"), F.coalesce("content_type", F.lit("")).alias("content_type"), known("json_datetime").alias("json_datetime"), known("exif_datetime").alias("exif_datetime"),
    )


def first_mode(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the most frequent non-empty value, of equals the one seen first in ``order``."""
    counted = df.where(F.trim(F.col(value)) != "").groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return counted.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("o"))).alias(value))


def absorbed_pairs(assets: DataFrame, key: str = "sha256", id_col: str = "asset_id", path: str = "path") -> DataFrame:
    """(canonical, absorbed) rows: every copy but the survivor, with both files and what both have of sidecars.

    The canonical's sidecars are those after the union; the copy's are its own.
    The folded groups are joined back; a hash with very many copies is split by
    the join's skew handling, as one folded row meets them.
    """
    known = _keyed(assets.where(F.col(key).isNotNull()), key, id_col)
    best = known.groupBy("_key").agg(F.min_by(F.struct(F.col(id_col).alias("id"), F.col(path).alias("path")), _key(path)).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = best.join(united_sidecars(known, path), "_key", "left").select("_key", "c", F.coalesce(F.size("sidecars"), F.lit(0)).alias("_sides"))
    count = F.when(F.col("_sides") > 0, F.col("_sides")).otherwise(0)
    pairs = known.join(sides, "_key").where(F.col(id_col) != F.col("c.id"))
    return pairs.select(
        F.col("c.id").alias("canonical_asset_id"), F.col(id_col).alias("absorbed_asset_id"), key, F.col("c.path").alias("canonical_file_path"), F.col(path).alias("absorbed_file_path"), count.alias("canonical_sidecar_count"),
        F.col("sidecar_count").alias("absorbed_sidecar_count"), (count > 0).alias("canonical_has_sidecar"), F.col("has_sidecar").alias("absorbed_has_sidecar"), F.lit(ABSORBED).alias("dedupe_action"),
    )


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
