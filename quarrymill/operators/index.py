"""Asset tables: assembling them from files, and the photo and video views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymill.functions import coerce, names
from quarrymill.operators import joins
from quarrymill.operators.tables import require, with_defaults, with_nulls
from quarrymill.operators.cleanup import is_video


def with_asset_ids(metric: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """A metric table by file_path with the index's asset_id; ValueError if a path isn't in the index."""
    if "asset_id" in metric.columns:
        return metric
    lost = joins.missing_ids(metric, index, "file_path").limit(1).count()
    if lost:
        raise ValueError(f"{name} has paths that the index lacks")
    return metric.join(index.select("file_path", "asset_id").dropDuplicates(["file_path"]), "file_path", "left")


def assemble_assets(files: DataFrame, hashes: DataFrame, images: DataFrame, dates: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One asset per media file.

    ``files`` are raw files; ``hashes`` (file_path, sha256), ``images`` (path,
    width, height, phash, sharpness), ``dates`` (path, exif_datetime) and ``sidecars``
    (path, json_datetime) are joined by path; a sidecar is linked by the file's
    name, else its stem.
    """
    media = files.where(F.startswith("file_role", F.lit("media/"))).withColumn("folder", F.col("album_path")).withColumn("name", F.col("file_name")).withColumn("stem", names.stem(F.col("file_name")))
    side = files.where("file_role = 'sidecar'").select(F.col("album_path").alias("folder"), F.col("file_name").alias("name"), F.col("file_path").alias("path"))
    linked = joins.sidecars_of(media, side)
    joined = linked.join(hashes, "file_path", "left").join(images.withColumnRenamed("path", "file_path"), "file_path", "left").join(dates.withColumnRenamed("path", "file_path"), "file_path", "left").join(sidecars.withColumnRenamed("path", "json_path"), "json_path", "left")
    paths = F.when(F.col("json_path").isNotNull(), F.array("json_path")).otherwise(F.array().cast("array<string>"))
    kind = names.content_type(F.col("file_path"), F.col("width"), F.col("height"), F.lit(None).cast("double"))
    return joined.select(
        names.asset_id(F.col("file_path")).alias("asset_id"), "file_path", F.col("file_path").alias("primary_file_path"), "file_name", "extension", "file_size", "created_at_fs", "sha256", "phash", "width", "height", "sharpness",
        "exif_datetime", "json_datetime", "json_path", "album_path", F.when(F.col("file_role") == "media/video", "video").otherwise("image").alias("mime_type"),
        (F.col("file_role") == "media/photo").alias("is_image"), (F.col("file_role") == "media/video").alias("is_video"), paths.alias("sidecar_paths"), F.size(paths).alias("sidecar_count"), (F.size(paths) > 0).alias("has_sidecar"),
        kind.alias("content_type_file"), F.when(F.col("file_role") == "media/photo", F.when(F.col("width").isNotNull(), "ok").otherwise("failed")).alias("decode_status"),
    )


def photo_index(assets: DataFrame) -> DataFrame:
    """Images with a hash."""
    return require(assets, ["is_image", "phash", "primary_file_path"]).where(coerce.truth(F.col("is_image"), False) & F.col("phash").isNotNull()).withColumn("file_path", F.col("primary_file_path"))


#: Suffixes of the photos that are grouped.
GROUPED = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic")


def grouping_photos(photos: DataFrame) -> DataFrame:
    """Photos that the grouping takes: with a hash, not flagged as anything but an image, of a known suffix; absent times and albums are null and empty."""
    require(photos, ["file_path", "phash", "width", "height"])
    rows = with_nulls(with_defaults(photos, {"album_path": ""}), {"created_at_fs": "double", "json_datetime": "string", "exif_datetime": "string"})
    if "is_image" in rows.columns:
        rows = rows.where(coerce.truth(F.col("is_image"), False))
    return rows.where(F.col("phash").isNotNull() & names.suffix(F.col("file_path")).isin(*GROUPED))


#: Columns of an asset that group members get.
MEMBER_COLUMNS = ("asset_id", "primary_file_path", "sidecar_paths", "sidecar_count", "has_sidecar", "content_type_file")


def with_asset_columns(members: DataFrame, assets: DataFrame) -> DataFrame:
    """Group members (file_path, ...) with their asset's columns, as far as they exist; of assets that repeat a path the least id."""
    if "file_path" not in assets.columns:
        return members
    have = [c for c in MEMBER_COLUMNS if c in assets.columns and c not in members.columns]
    side = assets.groupBy("file_path").agg(F.min(F.struct(*have)).alias("_a")) if have else assets.select("file_path").distinct()
    return members.join(side, "file_path", "left").select(*members.columns, *[F.col(f"_a.{c}").alias(c) for c in have])


def video_index(assets: DataFrame) -> DataFrame:
    """Videos by flag, type or suffix, once per asset, with empty metric columns."""
    videos = assets.where(is_video(F.col("is_video"), F.col("mime_type"), names.suffix(F.col("file_path")), names.VIDEO)).dropDuplicates(["asset_id"])
    empty = {"duration_sec": "double", "fps": "double", "bitrate_kbps": "double", "audio_present": "boolean", "video_codec": "string", "audio_codec": "string"}
    return with_nulls(videos, empty).withColumn("video_index_status", F.lit("indexed"))


def with_video_metrics(index: DataFrame, metrics: DataFrame, key: str = "asset_id") -> DataFrame:
    """The index with the metrics: where both have a column the metric stands, the index fills its nulls."""
    both = [c for c in metrics.columns if c in index.columns and c != key]
    side = metrics.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_metric_{c}") if c in both else F.col(c) for c in metrics.columns if c != key])
    joined = index.join(side, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_metric_{c}"), F.col(c)) for c in both}).drop(*[f"_metric_{c}" for c in both])


def photo_rows(photos: DataFrame) -> DataFrame:
    """Photos as the neighbour joins take them: id, album, ts, name, seq, aspect, bits, phash, file_path."""
    return photos.select(
        F.col("file_path").alias("id"), names.album_key(F.col("album_path")).alias("album"), coerce.capture_seconds(F.col("exif_datetime"), F.col("json_datetime"), F.col("created_at_fs")).alias("ts"), F.col("file_name").alias("name"),
        names.last_number(F.col("file_name")).alias("seq"), names.aspect(F.col("width"), F.col("height")).alias("aspect"), F.conv("phash", 16, -10).cast("long").alias("bits"), "phash", "file_path",
    )


def video_rows(videos: DataFrame) -> DataFrame:
    """Videos as the neighbour join takes them: id, album, ts, num, source, name, width, height, codec, duration."""
    ts, source = coerce.chosen_time(F.col("json_datetime"), F.col("created_at_fs"))
    return videos.select(F.col("asset_id").alias("id"), names.album_key(F.col("album_path")).alias("album"), ts.alias("ts"), names.numeric_token(F.col("file_name")).alias("num"), source.alias("source"), F.col("file_name").alias("name"), "width", "height", F.col("video_codec").alias("codec"), F.col("duration_sec").alias("duration"))


def split_scores(scored: DataFrame, features: list[str], semantic: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables, once per asset: measured features and semantic scores; columns that don't exist are left out."""
    one = scored.dropDuplicates(["asset_id"])
    pick = lambda columns: one.select("asset_id", *[c for c in columns if c in one.columns])
    return pick(features), pick(semantic)


def subject_source(face_metrics: DataFrame | None, subject: DataFrame | None) -> tuple[DataFrame, str]:
    """Face metrics if they have what is needed, else subject scores; which of them it is. ValueError if neither."""
    if face_metrics is not None and {"file_path", "faces", "face_symmetry"} <= set(face_metrics.columns):
        return face_metrics, "face_metrics"
    if subject is not None:
        return subject, "subject"
    raise ValueError("neither face metrics nor subject scores")
