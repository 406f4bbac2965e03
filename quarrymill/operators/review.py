"""What a reviewer sees: groups, their rows, and the metrics that tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions import names
from quarrymill.functions.coerce import number, sidecar_list, truth
from quarrymill.operators.cleanup import trash
from quarrymill.operators.tables import with_defaults

#: Columns that hold a row's comma-joined tags.
TAGS = ("content_type_scene", "content_type_group", "content_type_file")
#: Columns that are keys or repeat the group, and are no metrics.
HIDDEN = ("group_id", "file_path", "is_best", "file_name", "file_stem", "best_file", "best_score", "scene_group_id", "scene_group_size", "scene_group_group_count", "scene_merge_candidate", "display_id")


def review_table(rows: DataFrame) -> DataFrame:
    """Rows with the columns a review needs: a scene (else the group), and each tag (else the narrower one)."""
    if "scene_group_id" not in rows.columns:
        rows = rows.withColumn("scene_group_id", F.col("group_id"))
    wider = {"content_type_file": F.lit(""), "content_type_group": F.col("content_type_file"), "content_type_scene": F.col("content_type_group")}
    for name, default in wider.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    return rows


def displayed(rows: DataFrame, scenes: bool = True, scene: str = "scene_group_id", group: str = "group_id") -> DataFrame:
    """Rows with ``display_id``: their scene, or without one, or without ``scenes``, their group."""
    return rows.withColumn("display_id", F.coalesce(scene, group) if scenes and scene in rows.columns else F.col(group))


def _labels(per: DataFrame) -> DataFrame:
    """Groups with their common label (the display id) and the strict groups in it, unless they are the same."""
    common = F.col("display_id").cast("string")
    strict = F.array_join(F.transform(F.array_sort("_strict"), lambda g: g.cast("string")), ", ")
    return per.withColumns({"common_label": common, "private_label": F.when(strict == common, "").otherwise(strict)}).withColumn("label", F.trim(F.concat_ws(" ", "common_label", "private_label"))).drop("_strict")


def photo_groups(rows: DataFrame, enabled: list[str], scenes: bool = True, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(display_id, size, categories, common_label, private_label, label) of groups of which some category is enabled.

    A row's tags are comma-joined lists in up to three columns; untagged groups
    never show.  Rows are folded by their tag texts first, so a group of very
    many rows is no large set.
    """
    shown = displayed(rows, scenes)
    own = F.array_distinct(F.flatten(F.array(*[names.content_labels(F.col(t)) for t in tags if t in rows.columns])))
    per = shown.groupBy("display_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("categories"), F.collect_set("group_id").alias("_strict"))
    return _labels(per.where(F.arrays_overlap("categories", F.array(*[F.lit(e) for e in enabled]).cast("array<string>"))))


def video_review_groups(rows: DataFrame, group: str = "video_group_id", live: bool = True, regular: bool = True, single: bool = False, flag: str = "is_live") -> DataFrame:
    """(group, size, has_live, has_regular) of groups with any wanted kind of video; groups of one only on request. A null flag is a regular video."""
    is_live = F.coalesce(truth(F.col(flag), False), F.lit(False)) if flag in rows.columns else F.lit(False)
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.bool_or(is_live).alias("has_live"), F.bool_or(~is_live).alias("has_regular"))
    kept = (F.col("has_live") & F.lit(live)) | (F.col("has_regular") & F.lit(regular))
    return per.where(kept & (F.lit(single) | (F.col("size") > 1)))


def metric_columns(columns: list[str]) -> list[str]:
    """The metrics of a review table in order; width and height are one."""
    own = sorted(c for c in columns if c not in HIDDEN)
    return [c for c in own if c not in ("width", "height")] + ["size_wh"] if {"width", "height"} <= set(columns) else own


def varying_columns(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, metric) for every metric that has several different texts in the group; null is one text.

    Where ``columns`` hold width and height, they give way to size_wh, which is
    always shown.
    """
    shown = [c for c in columns if c not in ("width", "height")] if {"width", "height"} <= set(columns) else columns
    if not columns:
        return rows.select(group, F.lit("").alias("metric")).limit(0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__NA__"))
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[(F.min(text(c)) != F.max(text(c))).alias(c) for c in shown])
    named = F.array(*[F.when(F.col(c), F.lit(c)) for c in shown], *[F.lit("size_wh")] * (len(shown) < len(columns)))
    return per.select(group, F.explode(F.filter(named, lambda c: c.isNotNull())).alias("metric"))


def _metric(name: str, columns: list[str]) -> tuple[Column, Column]:
    """A metric's raw text and its display text."""
    if name == "size_wh":
        w, h = (F.coalesce(*[number(F.col(c)) for c in (side, f"{side}_final") if c in columns]) for side in ("width", "height"))
        return F.lit(None).cast("string"), names.size_text(w, h)
    return F.col(name).cast("string"), names.metric_text(name, F.col(name))


def group_rows(rows: DataFrame, value, scenes: bool = True, all_metrics: bool = False) -> DataFrame:
    """A group's rows as they are shown: (asset_id, file_path, file_name, is_best, metrics), by stem and name, the best first, then by path.

    ``metrics`` is a list of (metric, raw, text, is_best): is_best marks the
    group's highest number of the metric.  Only metrics that differ within the
    group are listed unless ``all_metrics``.
    """
    own = displayed(review_table(rows), scenes).where(F.col("display_id") == F.lit(value))
    known = metric_columns([c for c in rows.columns if c not in TAGS or c in own.columns])
    seen = known if all_metrics else [r["metric"] for r in varying_columns(own, "display_id", [c for c in known if c != "size_wh"] + ["width", "height"] * ("size_wh" in known)).collect()]
    shown = [c for c in known if c in seen]
    path, best = F.col("file_path"), F.coalesce(F.col("is_best"), F.lit(False)) if "is_best" in rows.columns else F.lit(False)
    top = metric_maxima(own, [c for c in shown if c != "size_wh"]).first()  # one row
    fields = []
    for name in shown:
        raw, text = _metric(name, rows.columns)
        highest = F.coalesce(number(raw) == F.lit(top[f"_top_{name}"]), F.lit(False)) if name != "size_wh" else F.lit(False)
        fields.append(F.struct(F.lit(name).alias("metric"), raw.alias("raw"), text.alias("text"), highest.alias("is_highest")))
    kind = "array<struct<metric:string,raw:string,text:string,is_highest:boolean>>"
    name, stem = F.lower(names.file_name(path)), F.lower(names.stem(path))
    out = own.select(F.col("asset_id").cast("string").alias("asset_id"), "file_path", names.file_name(path).alias("file_name"), best.alias("is_best"), (F.array(*fields) if fields else F.array()).cast(kind).alias("metrics"))
    return out.orderBy(stem, name, F.col("is_best").desc(), "file_path")


def metric_maxima(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the highest number of each metric, as _top_<metric>; null where none is a number."""
    return rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(number(F.col(c))).alias(f"_top_{c}") for c in columns])


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and those that a delete of ``ids`` takes; callers write the first and count the second."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_anti"), rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def delete(rows: DataFrame, ids: list[str], folder: str, allowed: str, dry_run: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """The rows that stay, and counts of a reviewer's delete: assets that matched, files and sidecars moved to the trash.

    The list of ids comes from a reviewer, so its files are listed on the driver.
    Only files below ``allowed`` move, and none in a dry run.
    """
    wanted = F.col("asset_id").cast("string").isin([i for i in ids if i.strip()])
    table = with_defaults(rows, {c: "" for c in ("sidecar_paths", "json_path") if c not in rows.columns})
    sides = sidecar_list(F.to_json("sidecar_paths") if dict(table.dtypes)["sidecar_paths"].startswith("array") else F.col("sidecar_paths"))
    listed = F.array_distinct(F.concat(sides, sidecar_list(F.col("json_path"))))
    gone = table.where(wanted).select("asset_id", "file_path", listed.alias("sides")).collect()
    files = trash([r["file_path"] for r in gone if r["file_path"]], folder, allowed, dry_run)
    sidecars = trash([s for r in gone for s in r["sides"]], folder, allowed, dry_run)
    counts = {"deleted_assets": len({r["asset_id"] for r in gone}), "deleted_files": files["moved"], "deleted_sidecars": sidecars["moved"], "outside": files["outside"] + sidecars["outside"]}
    return rows.where(~F.coalesce(wanted, F.lit(False))), counts


#: Display names of the metrics, and what each means, in the order in which they are shown.
METRICS = {
    "final_score": ("Score", "What the best of a photo group is chosen by."),
    "video_score": ("Video score", "What the best of a video group is chosen by."),
    "video_score_raw": ("Score before penalties", "The weighted sum before a live photo's penalty."),
    "live_photo_penalty": ("Live photo penalty", "What a video loses as part of a live photo."),
    "sharpness": ("Sharpness", "Variance of the image's Laplacian."),
    "composition_score": ("Composition", "Place, size, edges and tilt of the largest face."),
    "subject_score": ("Subject", "Size and place of the best face."),
    "aesthetic_score": ("Aesthetics", "The aesthetic model's score."),
    "subject_placement": ("Subject placement", "Nearness of the largest face to a thirds point."),
    "face_coverage": ("Face coverage", "Share of the frame that the largest face takes."),
    "edge_penalty": ("Edge penalty", "Whether the largest face reaches into the margin."),
    "tilt_score": ("Tilt", "How level the lines of the image are."),
    "pixels": ("Pixels", "Width by height."),
    "size_wh": ("Size in pixels", "Width and height."),
    "file_size": ("File size", "Size of the file on disk."),
    "duration_sec_final": ("Duration", "Seconds of a video."),
    "fps_final": ("Frame rate", "Frames a second."),
    "bitrate_kbps_final": ("Bit rate", "Kilobits a second."),
    "audio_present_final": ("Audio", "Whether a video has sound."),
    "has_live_photo_pair": ("Live photo", "Whether a photo belongs to the video."),
    "live_photo_status": ("Live photo match", "How sure the pair of video and photo is."),
    "content_type_file": ("File tags", "Kind of the file's content."),
    "content_type_group": ("Group tags", "Kinds of content in the strict group."),
    "content_type_scene": ("Scene tags", "Kinds of content in the scene."),
}


def meta() -> dict[str, object]:
    """What a client needs to show the tables."""
    return {"mediaModes": ["photo", "video"], "metricLabels": {k: v[0] for k, v in METRICS.items()}, "metricHelp": {k: v[1] for k, v in METRICS.items()}}


def split_label(label: str) -> tuple[str, list[str]]:
    """A group's display id and the strict groups in it, from "scene a, b"."""
    scene, _, groups = label.partition(" ")
    return scene, [g.strip() for g in groups.split(",") if g.strip()]


def scene_labels(rows: DataFrame, scene: str = "scene_group_id", group: str = "group_id") -> DataFrame:
    """(scene, label): "scene a, b" with the strict groups in order, or the scene alone if it is its only group."""
    per = rows.groupBy(F.col(scene).alias("display_id")).agg(F.collect_set(group).alias("_strict"))
    return _labels(per).select(F.col("display_id").alias(scene), "label")
