"""The photo pipeline as one lazy plan over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.functions import media, scores
from quarrymill.operators import curation, dedupe, graph, index, order, ranking, similarity
from quarrymill.plans.storage import stored
from quarrymill.sources import files


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(raw files, assets) of a folder; contents are hashed and decoded in one pass each."""
    raw = stored(files.raw_files(files.listing(spark, root), root), "raw-files")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    dates = F.arrow_udf(media.exif_dates, "string")
    read = stored(content.where(~F.endswith("path", F.lit(".json"))).select(path.alias("file_path"), F.sha2("content", 256).alias("sha256"), dates(F.col("content")).alias("exif_datetime")), "contents")
    image_files = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    images = media.with_image_features(image_files).withColumn("path", F.regexp_replace("path", r"^file:/*", "/"))
    sidecars = files.sidecars(spark, root)
    assets = index.assemble_assets(raw, read.select("file_path", "sha256"), images, read.select(F.col("file_path").alias("path"), "exif_datetime"), sidecars)
    return raw, stored(assets, "assets")


def unique_assets(assets: DataFrame) -> DataFrame:
    """Survivors of the exact copies, with united sidecars."""
    ranked = assets.select("asset_id", "sha256", F.col("file_path").alias("path"), "file_size", "has_sidecar", "sidecar_count", F.col("json_datetime").isNotNull().alias("has_json_time"), F.col("exif_datetime").isNotNull().alias("has_exif_time"), F.col("content_type_file").alias("content_type"), "json_datetime", "exif_datetime", "json_path", F.col("sidecar_paths").alias("sidecars"))
    folded = dedupe.fold_copies(ranked)
    rest = assets.drop("sha256", "has_sidecar", "sidecar_paths", "sidecar_count", "content_type_file", "json_datetime", "exif_datetime", "json_path")
    return folded.withColumnsRenamed({"sidecars": "sidecar_paths", "content_type": "content_type_file"}).join(rest, "asset_id")


def photo_pairs(photos: DataFrame, limits: similarity.Limits = similarity.LIMITS) -> DataFrame:
    """Hash edges: by prefix over all photos, then by neighbourhood in each album."""
    rows = index.photo_rows(photos)
    strict = stored(similarity.class_pairs(rows.select("id", "phash"), limits, "id"), "strict-pairs")
    placed = order.positions(rows.drop("phash", "file_path"), [F.col("album"), F.col("ts"), F.col("name"), F.col("id")])
    return stored(strict.union(similarity.without_edges(similarity.local_pairs(placed, limits), strict).select(strict.columns)), "pairs")


def photo_groups(pairs: DataFrame, scene_pairs: DataFrame | None = None) -> DataFrame:
    """(file_path, group_id, scene_group_id): components of strict edges, and of those with the scene edges."""
    strict = graph.group_ids(graph.connected_components(pairs, "img1", "img2")).select(F.col("node").alias("file_path"), "group_id")
    wider = pairs.select("img1", "img2") if scene_pairs is None else pairs.select("img1", "img2").union(scene_pairs.select("img1", "img2"))
    scene = graph.group_ids(graph.connected_components(wider, "img1", "img2"), group="scene_group_id").select(F.col("node").alias("file_path"), "scene_group_id")
    return strict.join(scene, "file_path", "left")


def ranked(groups: DataFrame, photos: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Group members with scores and whether they are their group's best; absent metrics count 0."""
    joined = groups.join(photos, "file_path").withColumn("pixels", F.col("width") * F.col("height"))
    if metrics is not None:
        joined = joined.join(metrics.dropDuplicates(["asset_id"]), "asset_id", "left")
    filled = index.with_defaults(joined, {"sharpness": 0.0, "subject_score": 0.0, "composition_score": 0.0, "aesthetic_score": 0.0, "pixels": 0.0})
    shares = scores.photo_shares() | {"file_size_n": F.col("file_size").cast("double")}
    termed = ranking.normalised(filled, "group_id", shares, scores.photo_ranges())
    scored = stored(termed.withColumn("final_score", scores.weighted(scores.PHOTO_SUBJECT)), "scored")
    return ranking.scene_sizes(ranking.mark_best(scored, "group_id", "final_score", "asset_id"), "scene_group_id", "group_id")


def library_plan(review: DataFrame, root: str, preserve_albums: bool = True) -> DataFrame:
    """Where the best of each group goes."""
    best = review.where("is_best").select("asset_id", "group_id", F.col("file_path").alias("path"), F.col("album_path").alias("album"), F.col("sidecar_paths").alias("sidecars"), F.col("final_score").alias("best_score"))
    return curation.curation_plan(best, root, preserve_albums)
