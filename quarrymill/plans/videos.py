"""The video branch: index and metrics to groups, scores and a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions import coerce, scores
from quarrymill.operators import index, order, ranking, tables, video
from quarrymill.plans.storage import stored

#: Measured columns of which a ``_final`` one is made.
MEASURED = ("duration_sec", "fps", "width", "height", "bitrate_kbps", "sidecar_count")


def grouped(videos: DataFrame, metrics: DataFrame, unit: float = 1.0) -> DataFrame:
    """The video index with its metrics, video_group_id (its least asset), video_group_size and video_group_status."""
    rows = stored(index.with_video_metrics(videos, metrics), "videos")
    placed = order.positions(index.video_rows(rows), [F.col("album"), F.col("ts").asc_nulls_last(), F.col("num").asc_nulls_last(), F.col("name"), F.col("id")])
    found = stored(video.video_groups(placed, video.video_links(placed, unit)), "video-groups").withColumnRenamed("id", "asset_id")
    joined = rows.join(found, "asset_id", "left")
    return ranking.group_sizes(joined, "video_group_id", "asset_id", "video_group_size").withColumn("video_group_status", F.lit("grouped"))


def with_finals(videos: DataFrame) -> DataFrame:
    """Rows with ``_final`` columns: the number in a column, else in its ``_metric``, else 0; pixels; sound as 1 or 0."""

    def first(name: str, read) -> Column:
        have = [read(F.col(c)) for c in (name, f"{name}_metric") if c in videos.columns]
        return F.coalesce(*have, F.lit(0.0))

    sound = lambda c: coerce.truth(c).cast("double")
    out = videos.withColumns({f"{c}_final": first(c, coerce.number) for c in MEASURED} | {"audio_present_final": first("audio_present", sound)})
    return out.withColumn("pixels_final", F.col("width_final") * F.col("height_final"))


def scored(videos: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Rows with live-photo columns, finals, norms within their group, video_score and the group's best.

    ``live`` are live-photo pairs (video_id, photo_id, time_gap, status).
    """
    tables.require(videos, ["asset_id", "video_group_id"])
    if live is not None:
        rows = video.with_live(videos, live)
    else:
        rows = tables.with_nulls(videos, {"live_photo_status": "string", "time_gap_sec": "double"}).withColumn("has_live_photo_pair", F.col("live_photo_status").isNotNull())
    rows = with_finals(tables.with_nulls(rows, {"video_metrics_status": "string", "file_name": "string"})).withColumn("live_photo_penalty", scores.live_penalty(F.col("live_photo_status")))
    shares = {"duration_norm": "duration_sec_final", "fps_norm": "fps_final", "pixels_norm": "pixels_final", "bitrate_norm": "bitrate_kbps_final", "sidecar_norm": "sidecar_count_final"}
    normed = ranking.normalised(rows, "video_group_id", {n: F.col(c) for n, c in shares.items()}).withColumn("ok", F.coalesce((F.col("video_metrics_status") == "ok").cast("double"), F.lit(0.0)))
    out = normed.withColumn("video_score_raw", scores.weighted(scores.VIDEO)).withColumn("video_score", scores.video_score(F.col("live_photo_penalty"))).drop("ok")
    return ranking.mark_best_video(out)


def review(best: DataFrame) -> DataFrame:
    """The scored videos as a review table: a group is its own scene, tagged as video."""
    sized = best if "video_group_size" in best.columns else ranking.group_sizes(best, "video_group_id", "asset_id", "video_group_size")
    own = tables.with_nulls(sized, {"content_type_file": "string"})
    return own.withColumns({
        "group_id": F.col("video_group_id"), "scene_group_id": F.col("video_group_id"), "is_best": F.col("is_best_video"), "final_score": F.col("video_score"), "media_type": F.lit("video"),
        "content_type_file": F.coalesce("content_type_file", F.lit("video")), "content_type_group": F.lit("video"), "content_type_scene": F.lit("video"), "scene_group_size": F.col("video_group_size"),
    })
