"""Scores as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The weights of the scores.
PHOTO_SUBJECT = {"subject_n": 0.34, "composition_score": 0.24, "aesthetic_n": 0.24, "sharpness_n": 0.14, "pixels_n": 0.04}
PHOTO_FACE = {"gaze_camera_score": 0.22, "eyes_score": 0.14, "yaw_score": 0.08, "symmetry_score": 0.08, "smile_n": 0.10, "composition_score": 0.14, "aesthetic_n": 0.14, "sharpness_n": 0.06, "faces_n": 0.03, "pixels_n": 0.01}
VIDEO = {"pixels_norm": 0.35, "bitrate_norm": 0.25, "fps_norm": 0.12, "duration_norm": 0.08, "audio_present_final": 0.10, "sidecar_norm": 0.05, "ok": 0.05}
LIVE_PENALTY = {"strong": 0.20, "probable": 0.10}


def photo_shares() -> dict[str, Column]:
    """The photo terms that are shares of their group's maximum."""
    return {"sharpness_n": F.col("sharpness"), "pixels_n": F.col("pixels")}


def photo_ranges() -> dict[str, Column]:
    """The photo terms that are stretched over their group's range, in subject mode."""
    return {"aesthetic_n": F.col("aesthetic_score"), "subject_n": F.col("subject_score")}


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight * column; null columns count 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()])


def live_penalty(status: Column) -> Column:
    kind = F.lower(F.trim(status))
    return F.when(kind == "strong", LIVE_PENALTY["strong"]).when(kind == "probable", LIVE_PENALTY["probable"]).otherwise(0.0)


def video_score(penalty: Column) -> Column:
    """Weighted sum less the penalty, at least 0, half-even to six places."""
    return F.bround(F.greatest(weighted(VIDEO) - penalty, F.lit(0.0)), 6)


def subject_placement(x: Column, y: Column) -> Column:
    """1 at a thirds point of the unit frame, falling by 1.5 per unit of distance, at least 0."""
    points = [(a / 3, b / 3) for a in (1, 2) for b in (1, 2)]
    nearest = F.least(*[F.sqrt((x - a) * (x - a) + (y - b) * (y - b)) for a, b in points])
    return F.greatest(F.lit(0.0), 1 - 1.5 * nearest)


def face_coverage(r: Column) -> Column:
    """1 between 0.05 and 0.35, linear below, falling one to one above."""
    return F.when(r < 0.05, r / 0.05).when(r <= 0.35, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (r - 0.35)))


def edge_penalty(x: Column, y: Column, w: Column, h: Column, margin: float = 0.05) -> Column:
    """1 if a box of the unit frame reaches into its margin, else 0."""
    touches = (x < margin) | (y < margin) | (x + w > 1 - margin) | (y + h > 1 - margin)
    return F.when(touches, 1.0).otherwise(0.0)


def subject_score(faces: Column) -> Column:
    """Best over faces (area, center: 0 to 1) of 0.6 * area + 0.4 * center; 0 without faces."""
    return F.coalesce(F.array_max(F.transform(faces, lambda f: 0.6 * f["area"] + 0.4 * f["center"])), F.lit(0.0))


def face_terms(columns: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """The face-mode terms from raw metrics: those to share by the group's maximum, and those kept in 0..1; absent columns and nulls count 0."""
    raw = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in columns else F.lit(0.0)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    shares = {"faces_n": raw("faces"), "eyes_score": raw("eyes_open_score"), "smile_n": raw("smile_score")}
    return shares, {"yaw_score": unit(1 - raw("head_yaw")), "symmetry_score": unit(raw("face_symmetry")), "gaze_camera_score": unit(raw("gaze_to_camera_score"))}
