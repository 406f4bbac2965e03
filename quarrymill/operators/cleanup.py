"""Which lower-rated copies may go."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions import names
from quarrymill.functions.coerce import number, truth
from quarrymill.operators import tables
from quarrymill.operators.facts import with_facts

#: Columns that may hold a rating, in the order of preference.
RATINGS = ("file_size_n", "rating", "total_score", "best_score", "score", "final_score")


#: Texts that mean "no value" in names of groups, hashes and sidecars.
EMPTY = ("", "nan", "none")
#: Suffixes of videos where neither a flag nor a type is known.
VIDEO_SUFFIXES = ("mov", "mp4", "avi", "mkv", "3gp", "webm")
GROUP_MODES = ("auto", "group_id", "exact")


def rating_column(columns: list[str], wanted: str | None = None) -> str | None:
    """The wanted rating, else the first known one; None if there is none, when only exact copies may go.

    ValueError if the wanted one isn't there.
    """
    if wanted and wanted not in columns:
        raise ValueError(f"no column {wanted}")
    return wanted or next((c for c in RATINGS if c in columns), None)


def duplicate_key(sha: Column, phash: Column, size: Column, width: Column, height: Column, suffix: Column, name: Column) -> Column:
    """The content hash; else hash, size, shape and suffix; else name and size."""
    text = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    shape = F.concat(width.cast("long"), F.lit("x"), height.cast("long"))
    strict = F.concat(F.lit("strict::"), text(phash), F.lit("::"), size, F.lit("::"), shape, F.lit("::"), suffix)
    return F.coalesce(text(sha), strict, F.concat(F.lit("fallback::"), F.lower(name), F.lit("::"), size))


def safe_subgroup(group: Column, key: Column) -> Column:
    return F.concat(group, F.lit("||"), key)


def is_video(flag: Column, mime: Column, suffix: Column, video_suffixes: tuple[str, ...]) -> Column:
    """The flag, or a video mime type or suffix; null counts as false."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.startswith(mime, F.lit("video")), F.lit(False)) | F.coalesce(suffix.isin(*video_suffixes), F.lit(False))


def sidecar_known(x: Column) -> Column:
    """Whether a path column names a sidecar."""
    text = F.lower(F.trim(x.cast("string")))
    return F.coalesce(~text.isin(*EMPTY, "null", "false", "0", "0.0"), F.lit(False))


def photos_only(df: DataFrame) -> DataFrame:
    """Rows that aren't videos: by flag if there is one (null: no video), else by type, else by suffix."""
    if "is_video" in df.columns:
        video = F.coalesce(truth(F.col("is_video"), False), F.lit(False))
    elif "mime_type" in df.columns:
        video = F.coalesce(F.startswith(F.lower("mime_type"), F.lit("video")), F.lit(False))
    else:
        video = names.suffix(F.col("file_path")).isin(*VIDEO_SUFFIXES)
    return df.where(~video)


def working_frame(df: DataFrame, rating: str | None = None, mode: str = "auto", videos: bool = False) -> DataFrame:
    """Rows with what a cleanup needs: sha, has_json, rating, duplicate_key, comparison_group and its source, safe_subgroup.

    ``df`` needs file_path and file_size; json_path, sha256, phash, width,
    height, group_id and the rating may be missing.  Rows with a blank path go,
    and videos do unless ``videos``.  Groups are the strict groups where a row
    has one and else its duplicates ("auto"), always the strict groups
    ("group_id"), or always the duplicates ("exact").
    """
    if mode not in GROUP_MODES:
        raise ValueError(f"mode must be one of {GROUP_MODES}")
    tables.require(df, ["file_path", "file_size"] + ["group_id"] * (mode == "group_id"))
    rows = df.withColumn("file_path", F.trim("file_path")).where("file_path <> ''")
    rows = rows if videos else photos_only(rows)
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    clean = lambda c: F.when(~F.lower(F.trim(have(c, "string"))).isin(*EMPTY), F.lower(F.trim(have(c, "string"))))
    path = F.col("file_path")
    extension = F.concat(F.when(names.suffix(path) != "", F.lit(".")).otherwise(""), names.suffix(path))
    key = duplicate_key(clean("sha256"), clean("phash"), F.col("file_size"), number(have("width", "double")), number(have("height", "double")), extension, names.file_name(path))
    group = have("group_id", "string").cast("string")
    grouped = F.coalesce(~F.lower(F.trim(group)).isin(*EMPTY), F.lit(False)) if mode == "auto" else F.lit(mode == "group_id")
    named = F.concat(F.lit("group_id::"), F.coalesce(group, F.lit("nan")))
    score = number(F.col(rating)) if rating else F.lit(None).cast("double")
    rows = rows.withColumns({"sha": clean("sha256"), "has_json": sidecar_known(have("json_path", "string")), "rating_value": score, "duplicate_key": key})
    compared = F.when(grouped, named).otherwise(F.col("duplicate_key"))
    source = F.when(grouped, "group_id").otherwise("exact")
    return rows.withColumns({"comparison_group": compared, "comparison_group_source": source, "safe_subgroup": safe_subgroup(compared, F.col("duplicate_key"))})


def delete_candidates(df: DataFrame, subgroup: str = "safe_subgroup", rating: str = "rating", equal: bool = False) -> DataFrame:
    """Rows without a sidecar that their subgroup can spare.

    ``df`` has sha, has_json and the rating. A subgroup counts if it has rows
    with and without sidecar. If all have the same content hash, every row
    without goes; else those rated below the best with a sidecar (or as high,
    with ``equal``). A null rating stays.
    """
    facts = {
        "_with": F.bool_or("has_json"), "_best": F.max(F.when(F.col("has_json"), F.col(rating))),
        "_n": F.count(F.lit(1)), "_shas": F.count("sha"), "_low": F.min("sha"), "_high": F.max("sha"),
    }
    lower = F.col(rating) <= F.col("_best") if equal else F.col(rating) < F.col("_best")
    exact = (F.col("_shas") == F.col("_n")) & (F.col("_low") == F.col("_high"))
    reason = F.when(exact, "exact_copy_without_json").when(lower, "lower_rated")
    judged = with_facts(df, subgroup, facts).where(~F.col("has_json") & F.col("_with"))
    return judged.withColumn("reason", reason).where("reason IS NOT NULL").drop(*facts)


def deletion_paths(rows: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(id, path, kind): the primary and sidecar paths of the rows, each path once."""
    paths = F.concat(F.array(F.struct(F.col("path").alias("path"), F.lit("primary").alias("kind"))), F.transform("sidecars", lambda s: F.struct(s.alias("path"), F.lit("sidecar").alias("kind"))))
    each = rows.select(id_col, F.explode(paths).alias("p")).select(id_col, "p.*")
    return each.groupBy("path").agg(F.min(F.struct(id_col, "kind")).alias("m")).select(f"m.{id_col}", "path", "m.kind")


def trash(paths: list[str], folder: str, allowed: str, dry_run: bool = True) -> dict[str, int]:
    """Moves files into a trash folder, on the driver: {moved, missing, outside}.

    Only files below ``allowed`` move, and none in a dry run, which counts what
    would.  A name that the trash holds already gets a number.
    """
    counts, root = {"moved": 0, "missing": 0, "outside": 0}, os.path.realpath(allowed)
    for path in dict.fromkeys(paths):
        if os.path.commonpath([root, os.path.realpath(path)]) != root:
            counts["outside"] += 1
        elif not os.path.exists(path):
            counts["missing"] += 1
        else:
            counts["moved"] += 1
            if not dry_run:
                os.makedirs(folder, exist_ok=True)
                name, n = os.path.basename(path), 0
                while os.path.exists(target := os.path.join(folder, f"{n}-{name}" if n else name)):
                    n += 1
                shutil.move(path, target)
    return counts
