"""Neighbouring videos and live-photo pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions.coerce import number
from quarrymill.operators.graph import connected_components
from quarrymill.operators.order import lookahead

AHEAD = 8


def same_resolution(l: str, r: str) -> Column:
    w, h = F.col(f"{l}.width") == F.col(f"{r}.width"), F.col(f"{l}.height") == F.col(f"{r}.height")
    return F.coalesce(w & h & (F.col(f"{l}.width") > 0) & (F.col(f"{l}.height") > 0), F.lit(False))


def same_codec(l: str, r: str) -> Column:
    a, b = (F.lower(F.trim(F.col(f"{side}.codec"))) for side in (l, r))
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def duration_ratio(l: str, r: str) -> Column:
    a, b = F.col(f"{l}.duration"), F.col(f"{r}.duration")
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def link_reason(unit: float = 1.0) -> Column:
    """Why two neighbours (l, r) belong together, by the first rule that holds; null if none does. ``unit`` scales seconds.

    The number rules need a sidecar's time on either side; two file times get
    the stricter file rule.
    """
    dt = F.abs(F.col("l.ts") - F.col("r.ts")) / unit
    steps = F.abs(F.col("l.num") - F.col("r.num"))
    fs = F.col("l.source").eqNullSafe("fs") & F.col("r.source").eqNullSafe("fs")
    size, codec = same_resolution("l", "r"), same_codec("l", "r")
    return (
        F.when(dt <= 30, "close_time")
        .when(~fs & (steps <= 20) & (dt <= 120), "number_time")
        .when(~fs & (steps <= 6) & (dt <= 300) & (size | codec), "number_format")
        .when(fs & (steps <= 6) & (dt <= 45) & size, "file_time")
        .when((duration_ratio("l", "r") <= 1.35) & (dt <= 20) & size, "duration")
    )


def video_links(videos: DataFrame, unit: float = 1.0, ahead: int = AHEAD) -> DataFrame:
    """(src, dst, reason) of the next ``ahead`` videos of an album; ``videos`` has id, pos, album, ts, num, source, width, height, codec, duration."""
    found = lookahead(videos, ahead, within="album").withColumn("reason", link_reason(unit)).where("reason IS NOT NULL")
    return found.select(F.col("l.id").alias("src"), F.col("r.id").alias("dst"), "reason")


def video_groups(videos: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, group): the least id reachable over links; videos without links are groups of their own."""
    linked = connected_components(links).select(F.col("node").alias(id_col), "component")
    joined = videos.select(id_col).join(linked, id_col, "left")
    return joined.select(id_col, F.coalesce("component", id_col).alias("video_group_id"))


#: The longest duration of a live photo's video, the widest gap to its photo, and that of a strong pair.
LIVE_DURATION, LIVE_GAP, STRONG_GAP = 4.0, 5.0, 1.0


def live_pairs(videos: DataFrame, photos: DataFrame, most_gap: float = LIVE_GAP, most_duration: float = LIVE_DURATION, strong_gap: float = STRONG_GAP) -> DataFrame:
    """(video_id, photo_id, gap, status): a short video and a photo of the same album and stem, near in time.

    Null albums and stems match null ones; a null time or duration matches
    nothing.  Time is a join key too, in buckets of ``most_gap`` with a photo's
    neighbours, so an album and stem that very many rows share, or lack, is no
    product of all its rows.
    """
    v = videos.where((F.col("duration") <= most_duration) & F.col("ts").isNotNull()).select(F.col("id").alias("video_id"), F.col("album").alias("va"), F.col("stem").alias("vs"), F.col("ts").alias("vt"), F.floor(F.col("ts") / most_gap).alias("b"))
    near = F.floor(F.col("ts") / most_gap)
    p = photos.where(F.col("ts").isNotNull()).select(F.col("id").alias("photo_id"), F.col("album").alias("pa"), F.col("stem").alias("ps"), F.col("ts").alias("pt"), F.explode(F.array(near - 1, near, near + 1)).alias("pb"))
    gap = F.abs(F.col("vt") - F.col("pt"))
    pairs = v.join(p, (F.col("b") == F.col("pb")) & F.col("va").eqNullSafe(F.col("pa")) & F.col("vs").eqNullSafe(F.col("ps")) & (gap <= most_gap))
    return pairs.select("video_id", "photo_id", gap.alias("time_gap"), F.when(gap <= strong_gap, "strong").otherwise("probable").alias("live_photo_status"))


def nearest_live(pairs: DataFrame) -> DataFrame:
    """Per video the nearest photo, of equals the least id."""
    rank = F.struct(F.col("time_gap").isNull().alias("n"), F.col("time_gap").alias("g"), F.col("photo_id").alias("p"))
    return pairs.groupBy("video_id").agg(F.min_by(F.struct(*pairs.columns), rank).alias("_r")).select("_r.*")


def with_duration(videos: DataFrame, metrics: DataFrame, key: str = "asset_id") -> DataFrame:
    """Videos with the measured ``duration``: of a metric row that repeats an asset the least; unparsable ones are null."""
    side = metrics.groupBy(key).agg(F.min(number(F.col("duration_sec"))).alias("duration"))
    return videos.drop("duration").join(side, key, "left")


def with_live(videos: DataFrame, pairs: DataFrame, key: str = "asset_id") -> DataFrame:
    """Videos with their nearest photo's live_photo_status, time_gap_sec and id, and whether there is one."""
    side = nearest_live(pairs).select(F.col("video_id").alias(key), "live_photo_status", F.col("time_gap").alias("time_gap_sec"), F.col("photo_id").alias("live_photo_photo_asset_id"))
    own = videos.drop("live_photo_status", "time_gap_sec", "live_photo_photo_asset_id")
    return own.join(side, key, "left").withColumn("has_live_photo_pair", F.col("live_photo_status").isNotNull())
