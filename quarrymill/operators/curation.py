"""Plans and manifests of moves."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from quarrymill.functions.names import file_name, target_path


def curation_plan(best: DataFrame, root: str, preserve_albums: bool = True) -> DataFrame:
    """One row per asset: where its file and sidecars lie and where they go.

    ``best`` has asset_id, group_id, path, album, sidecars, best_score; the scene
    and the three tag columns go along if there are any.
    """
    more = [c for c in ("scene_group_id", "content_type_file", "content_type_group", "content_type_scene") if c in best.columns]
    place = F.col("album") if preserve_albums else F.lit("")
    move = lambda p: target_path(root, place, file_name(p))
    ranked = best.groupBy("asset_id").agg(F.min_by(F.struct("group_id", "path", "album", "sidecars", "best_score", *more), F.struct("group_id", "path")).alias("b"))
    rows = ranked.select("asset_id", "b.*")
    return rows.select("asset_id", "group_id", *[c for c in more if c not in ("group_id",)], F.lit("best_in_group").alias("selection_reason"), F.col("path").alias("primary_source_path"), move(F.col("path")).alias("primary_target_path"), F.col("sidecars").alias("sidecar_source_paths"), F.transform("sidecars", move).alias("sidecar_target_paths"), F.size("sidecars").alias("sidecar_count"), F.col("album").alias("album_path"), "best_score")


def manifest(plan: DataFrame) -> DataFrame:
    """The plan as one row per file: the primary first, then its sidecars."""
    first = F.array(F.struct(F.lit("primary").alias("entry_kind"), F.col("primary_source_path").alias("source_path"), F.col("primary_target_path").alias("target_path")))
    rest = F.zip_with("sidecar_source_paths", "sidecar_target_paths", lambda s, t: F.struct(F.lit("sidecar").alias("entry_kind"), s.alias("source_path"), t.alias("target_path")))
    return plan.select("asset_id", F.posexplode(F.concat(first, rest)).alias("entry", "m")).select("asset_id", "entry", "m.*")


def execute(rows: list[tuple[str, str]], allowed: str, dry_run: bool = True) -> list[str]:
    """Moves (source, target) files on the driver; statuses planned, moved, missing_source, target_exists, outside.

    Targets must lie below ``allowed``. Nothing moves in a dry run.
    """
    out, root = [], os.path.realpath(allowed)
    for source, target in rows:
        if os.path.commonpath([root, os.path.realpath(target)]) != root:
            out.append("outside")
        elif not os.path.exists(source):
            out.append("missing_source")
        elif os.path.exists(target):
            out.append("target_exists")
        elif dry_run:
            out.append("planned")
        else:
            Path(target).parent.mkdir(parents=True, exist_ok=True)
            shutil.move(source, target)
            out.append("moved")
    return out


#: What a batch of moves leaves behind: one row per file.
MOVES = "batch_id string, timestamp_utc string, asset_id string, entry_kind string, source_path string, target_path string, status string"
#: Files whose moves are written to the manifest together.
MOVE_ROWS = 10_000


def execute_plan(plan: DataFrame, allowed: str, path: str | None = None, dry_run: bool = True, now: datetime | None = None) -> dict[str, int]:
    """Moves a plan's files, primaries before their sidecars, and counts this batch's rows by status.

    The driver streams the plan, so it holds MOVE_ROWS rows at a time; they are
    appended to the manifest table at ``path`` (columns MOVES) before the next
    are moved.  Every row has the batch's id and its own time.
    """
    spark, began = plan.sparkSession, now or datetime.now(UTC)
    batch, counts = began.strftime("%Y%m%dT%H%M%SZ"), {}

    def written(rows: list) -> None:
        statuses = execute([(r["source_path"], r["target_path"]) for r in rows], allowed, dry_run)
        done = [(batch, (now or datetime.now(UTC)).isoformat(), str(r["asset_id"]), r["entry_kind"], r["source_path"], r["target_path"], s) for r, s in zip(rows, statuses)]
        for s in statuses:
            counts[s] = counts.get(s, 0) + 1
        if path and done:
            spark.createDataFrame(done, MOVES).write.mode("append").parquet(path)

    def streamed() -> Iterator[list]:
        held = []
        for r in manifest(plan).orderBy("asset_id", "entry").toLocalIterator():
            held.append(r)
            if len(held) == MOVE_ROWS:
                yield held
                held = []
        if held:
            yield held

    for rows in streamed():
        written(rows)
    return counts
