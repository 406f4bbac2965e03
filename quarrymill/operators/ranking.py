"""Scores inside groups and the best member of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions.coerce import NO_TAG
from quarrymill.operators.facts import with_facts


def normalised(df: DataFrame, group: str, shares: dict[str, Column] | None = None, ranges: dict[str, Column] | None = None) -> DataFrame:
    """Rows with columns normalised inside their group, kept in 0..1; null for null and in rows of a null group.

    ``shares`` are x / the group's maximum (1 if that isn't positive); ``ranges``
    are (x - min) / (max - min, or 1 if they are equal).
    """
    shares, ranges = shares or {}, ranges or {}
    facts = {f"_top_{n}": F.max(x) for n, x in (shares | ranges).items()} | {f"_low_{n}": F.min(x) for n, x in ranges.items()}
    joined = with_facts(df, group, facts)
    unit = lambda x: F.when(F.col(group).isNotNull() & x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    out = {n: unit(x / F.when(F.col(f"_top_{n}") > 0, F.col(f"_top_{n}")).otherwise(F.lit(1.0))) for n, x in shares.items()}
    for n, x in ranges.items():
        width = F.col(f"_top_{n}") - F.col(f"_low_{n}")
        out[n] = unit((x - F.col(f"_low_{n}")) / F.when(width != 0, width).otherwise(F.lit(1.0)))
    return joined.withColumns(out).drop(*facts)


def scene_sizes(df: DataFrame, scene: str, group: str) -> DataFrame:
    """Rows with their scene's size, its number of groups, and whether it has several; null, null and false without a scene."""
    joined = with_facts(df, scene, {"scene_group_size": F.count(F.lit(1)), "_groups": F.collect_set(group)})
    count = F.when(F.col(scene).isNotNull(), F.size("_groups").cast("long"))
    return joined.withColumn("scene_group_group_count", count).drop("_groups").withColumn("scene_merge_candidate", F.coalesce(F.col("scene_group_group_count") > 1, F.lit(False)))


def group_tags(df: DataFrame, group: str, tag: str, out: str, default: str | None = None) -> DataFrame:
    """Rows with their group's tags: sorted, different, joined.

    A row without a group keeps its own tag, or what stands in ``default``.
    """
    usable = F.when(~F.trim(tag).isin(*NO_TAG), F.trim(tag))
    joined = with_facts(df, group, {"_tags": F.collect_set(usable)})
    own = F.coalesce(F.col(default or tag), F.lit(""))
    return joined.withColumn(out, F.when(F.col(group).isNotNull(), F.array_join(F.array_sort("_tags"), ", ")).otherwise(own)).drop("_tags")


def content_tags(df: DataFrame, group: str = "group_id", scene: str = "scene_group_id", tag: str = "content_type_file") -> DataFrame:
    """Rows with the tags of their strict group and of their scene; a row without scene keeps its group's."""
    return group_tags(group_tags(df, group, tag, "content_type_group"), scene, tag, "content_type_scene", "content_type_group")


def _rank(score: str, id_col: str) -> Column:
    return F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col(id_col).alias("i"))


def best_rows(df: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """One row per group: the highest score, of equals the least id; null scores last."""
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), _rank(score, id_col)).alias("_r")).select("_r.*")


def mark_best(df: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """Rows with the best member's id and score and whether they are it; no row of a null group is."""
    joined = with_facts(df, group, {"_b": F.min(_rank(score, id_col))})
    return joined.withColumn("best_asset_id", F.col("_b.i")).withColumn("best_score", -F.col("_b.s")).withColumn("is_best", F.coalesce(F.col(id_col) == F.col("_b.i"), F.lit(False))).drop("_b")


def first_non_null_best(df: DataFrame, group: str, score: str, id_col: str, columns: list[str]) -> DataFrame:
    """Per group the first non-null value of each column in best-first order, so one row may mix members."""
    rank = F.struct(F.col(score).isNull(), -F.col(score), F.col(id_col))
    return df.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


#: What makes a video its group's best, each falling: score, pixels, bit rate, duration, frame rate.
VIDEO_ORDER = ("video_score", "pixels_final", "bitrate_kbps_final", "duration_sec_final", "fps_final")


def video_rank(order: tuple[str, ...] = VIDEO_ORDER, id_col: str = "asset_id") -> Column:
    """Ascending order of a group's videos as one struct: the least is the best, of equals the least id."""
    falling = [F.struct(F.col(c).isNull().alias("n"), (-F.col(c)).alias("v")).alias(c) for c in order]
    return F.struct(*falling, F.col(id_col).alias("id"))


def video_best(df: DataFrame, group: str = "video_group_id", order: tuple[str, ...] = VIDEO_ORDER, id_col: str = "asset_id") -> DataFrame:
    """The best video of each group, as a row."""
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), video_rank(order, id_col)).alias("_r")).select("_r.*")


def mark_best_video(df: DataFrame, group: str = "video_group_id", id_col: str = "asset_id", name: str = "file_name") -> DataFrame:
    """Rows with the best video's id, name and score (best_asset_id, best_file, best_score) and whether they are it."""
    best = F.struct(video_rank(id_col=id_col).alias("o"), F.col(name).alias("name"), F.col("video_score").alias("score"))
    joined = with_facts(df, group, {"_b": F.min(best)})
    return joined.withColumns({"best_asset_id": F.col("_b.o.id"), "best_file": F.col("_b.name"), "best_score": F.col("_b.score"), "is_best_video": F.coalesce(F.col(id_col) == F.col("_b.o.id"), F.lit(False))}).drop("_b")


def group_sizes(df: DataFrame, group: str, counted: str, out: str) -> DataFrame:
    """Rows with the number of their group's rows in which ``counted`` isn't null."""
    return with_facts(df, group, {out: F.count(counted)})
