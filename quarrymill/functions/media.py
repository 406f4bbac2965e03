"""Features of media bytes: hashes, sharpness, EXIF dates, probe documents, model scores.

What needs no decoder is NumPy or column arithmetic.  Detectors and models are
given by the caller as a function that loads them once per worker.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.functions import coerce, scores

#: EXIF tags of the dates, best first, and of the sub-directory that holds two of them.
EXIF_DATES, EXIF_IFD = (0x9003, 0x9004, 0x0132), 0x8769
#: Shares of an image that its crop views take: all, top, left, right.
VIEWS = {"full": (0.0, 0.0, 1.0, 1.0), "top": (0.0, 0.0, 1.0, 0.35), "left": (0.0, 0.0, 0.28, 1.0), "right": (0.72, 0.0, 1.0, 1.0)}


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of an image as Spark's image source holds it (rows of blue, green, red)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array([0.114, 0.587, 0.299])


def shrink(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area averages of an image over a grid."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        return np.maximum(high - low, 0) * m / n

    return weights(image.shape[0], rows) @ image @ weights(image.shape[1], columns).T


def perceptual_hash(image: np.ndarray) -> str:
    """Sixteen hex digits: which of the 8 x 8 lowest DCT terms of the 32 x 32 image exceed their median."""
    k, x = np.arange(32)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / 64)
    low = (basis @ shrink(image, 32, 32) @ basis.T)[:8, :8]
    return f"{int(''.join('01'[int(b)] for b in (low > np.median(low)).ravel()), 2):016x}"


def laplacian_variance(image: np.ndarray) -> float:
    """Sharpness: variance of the four-neighbour Laplacian, borders mirrored."""
    p = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image).var())


def crop(image: np.ndarray, view: str) -> np.ndarray:
    h, w = image.shape[:2]
    x0, y0, x1, y1 = VIEWS[view]
    return image[int(y0 * h) : max(int(y1 * h), int(y0 * h) + 1), int(x0 * w) : max(int(x1 * w), int(x0 * w) + 1)]


#: Fixed value: the longest side of an image that faces and lines are looked for in.
ANALYSIS_SIDE = 960


def analysis_size(height: int, width: int, most: int = ANALYSIS_SIDE) -> tuple[int, int]:
    """Rows and columns of an image scaled down to the analysis size; small images stay."""
    scale = min(1.0, most / max(height, width, 1))
    return max(1, int(height * scale)), max(1, int(width * scale))


def for_analysis(image: np.ndarray, most: int = ANALYSIS_SIDE) -> np.ndarray:
    """An image by area averages in the analysis size."""
    rows, columns = analysis_size(*image.shape, most)
    return image if (rows, columns) == image.shape else shrink(image, rows, columns)


#: Votes that make a line, and steps of its angle and distance.
LINE_VOTES, ANGLES = 150, 180
#: Gradients from which a pixel is an edge: surely, and next to a sure one.
EDGE_HIGH, EDGE_LOW = 150.0, 50.0


def edges(image: np.ndarray) -> np.ndarray:
    """Edge pixels: ridges of the Sobel gradient over EDGE_LOW that join one over EDGE_HIGH."""
    p = np.pad(np.asarray(image, np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    q = np.pad(size, 1)
    turn = np.round(np.arctan2(gy, gx) * 4 / np.pi).astype(int) % 4  # across, falling, down, rising
    n, m = size.shape
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    ridge = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(steps):
        before, after = q[1 - dy : 1 - dy + n, 1 - dx : 1 - dx + m], q[1 + dy : 1 + dy + n, 1 + dx : 1 + dx + m]
        ridge |= (turn == k) & (size > before) & (size >= after)
    weak, sure = ridge & (size > EDGE_LOW), ridge & (size > EDGE_HIGH)
    while True:
        q = np.pad(sure, 1)
        grown = weak & np.logical_or.reduce([q[1 + dy : 1 + dy + n, 1 + dx : 1 + dx + m] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == sure).all():
            return sure
        sure = grown


def line_angles(image: np.ndarray, votes: int = LINE_VOTES) -> list[float]:
    """Angles (radians) of the normals of straight lines: cells of the Hough space over ``votes`` that top their neighbours."""
    y, x = np.nonzero(edges(image))
    theta = np.arange(ANGLES) * np.pi / ANGLES
    reach = sum(image.shape)
    space = np.zeros((ANGLES, 2 * reach + 1), np.int64)
    for k, t in enumerate(theta):
        space[k] = np.bincount(np.round(x * np.cos(t) + y * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1)
    q = np.pad(space, 1)
    top = (space > votes) & (space > q[:-2, 1:-1]) & (space >= q[2:, 1:-1]) & (space > q[1:-1, :-2]) & (space >= q[1:-1, 2:])
    return [float(theta[k]) for k in np.nonzero(top)[0]]


def image_lines(images: pa.Array) -> pa.Array:
    """Line angles of structs of Spark's image source, in the analysis size; null where an image is broken."""
    out = []
    for im in images.to_pylist():
        try:
            out.append(line_angles(for_analysis(grey(im["data"], im["height"], im["width"], im["nChannels"]))))
        except (TypeError, ValueError):
            out.append(None)
    return pa.array(out, pa.list_(pa.float64()))


def image_features(images: pa.Array) -> pa.Array:
    """(phash, sharpness) of structs of Spark's image source; null where an image is broken."""
    out = []
    for im in images.to_pylist():
        try:
            g = grey(im["data"], im["height"], im["width"], im["nChannels"])
            out.append({"phash": perceptual_hash(g), "sharpness": laplacian_variance(g)})
        except (TypeError, ValueError):
            out.append(None)
    return pa.array(out, pa.struct([("phash", pa.string()), ("sharpness", pa.float64())]))


def with_image_features(images: DataFrame) -> DataFrame:
    """Rows of the image source with path, width, height, phash and sharpness."""
    features = F.arrow_udf(image_features, "struct<phash:string,sharpness:double>")
    return images.select(F.col("image.origin").alias("path"), F.nullif(F.col("image.width"), F.lit(-1)).alias("width"), F.nullif(F.col("image.height"), F.lit(-1)).alias("height"), features(F.col("image")).alias("f")).select("path", "width", "height", "f.*")


def _directory(tiff: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    (n,) = struct.unpack_from(order + "H", tiff, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        out[tag] = kind, count, tiff[at + 10 + 12 * k : at + 14 + 12 * k]
    return out


def exif_date(content: bytes | None) -> str | None:
    """The first of the original, digitised and changed dates in a JPEG's EXIF block."""
    at = (content or b"").find(b"Exif\0\0")
    if at < 0:
        return None
    tiff = content[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        tags = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        if EXIF_IFD in tags:
            tags |= _directory(tiff, order, struct.unpack(order + "I", tags[EXIF_IFD][2])[0])
        for tag in EXIF_DATES:
            if tag in tags:
                _, count, value = tags[tag]
                start = struct.unpack(order + "I", value)[0]
                if text := tiff[start : start + count].split(b"\0")[0].decode("ascii", "ignore").strip():
                    return text
    except struct.error:
        pass
    return None


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """An image of Spark's image source as rows of red, green, blue."""
    own = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(own, 3, axis=2) if channels == 1 else own[..., 2::-1]


def _unit(vectors) -> list[list[float]]:
    v = np.asarray(vectors, np.float64)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(size > 0, size, 1)).tolist()


def _embedded(rows: DataFrame, crops: Callable[[dict], list[np.ndarray]], load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], columns: list[str], batch: int, kind: pa.DataType, ddl: str, out: Callable[[dict, list], object]) -> DataFrame:
    """(path, out): crops of several images are encoded together, at most about ``batch`` at a time.

    A batch that the model can't take is tried image by image; an image that
    can't be read or encoded has null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for rb in batches:
            for at in range(0, len(rb), max(1, batch)):
                part = rb.slice(at, max(1, batch)).to_pylist()
                held, results = [], {}
                for k, row in enumerate(part):
                    try:
                        held.append((k, crops(row)))
                    except (TypeError, ValueError):
                        results[k] = None
                while held:
                    own, n = [], 0
                    while held and (not own or n + len(held[0][1]) <= batch):
                        own.append(held.pop(0))
                        n += len(own[-1][1])
                    for group in (own, *([x] for x in own)):
                        todo = [x for x in group if x[0] not in results]
                        try:
                            vectors = _unit(encode([c for _, cs in todo for c in cs])) if any(cs for _, cs in todo) else []
                        except Exception:  # noqa: BLE001  one image must not lose its batch
                            if len(todo) == 1:
                                results[todo[0][0]] = None
                            continue
                        for k, cs in todo:
                            results[k] = out(part[k], vectors[: len(cs)])
                            vectors = vectors[len(cs) :]
                paths, found = [r["image"]["origin"] if r["image"] else None for r in part], [results.get(k) for k in range(len(part))]
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(found, kind)], names=["path", "v"])

    return rows.select("image", *columns).mapInArrow(run, f"path string, v {ddl}")


def view_embeddings(images: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(path, v): unit vectors of an image's views in the order of VIEWS; ``load`` gives an encoder of pixel arrays."""

    def crops(row: dict) -> list[np.ndarray]:
        im = row["image"]
        own = pixels(im["data"], im["height"], im["width"], im["nChannels"])
        return [crop(own, view) for view in VIEWS]

    return _embedded(images, crops, load, [], batch, pa.list_(pa.list_(pa.float64())), "array<array<double>>", lambda row, v: v)


def face_embeddings(images: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], faces: str = "boxes", batch: int = 64) -> DataFrame:
    """(path, v): (x, unit vector) of each padded face box (x, y, w, h in pixels) from left to right; an image without faces has none."""

    def boxed(row: dict) -> list[tuple[int, int, int, int]]:
        im = row["image"]
        ends = ((max(0, int(f["x"])), max(0, int(f["y"])), min(im["width"], int(f["x"] + f["w"])), min(im["height"], int(f["y"] + f["h"]))) for f in row[faces] or ())
        return [e for e in ends if e[0] < e[2] and e[1] < e[3]]

    def crops(row: dict) -> list[np.ndarray]:
        im = row["image"]
        own = pixels(im["data"], im["height"], im["width"], im["nChannels"])
        return [own[y0:y1, x0:x1] for x0, y0, x1, y1 in boxed(row)]

    def out(row: dict, vectors: list) -> list[dict]:
        centres = [(x0 + x1) / 2 for x0, _, x1, _ in boxed(row)]
        return sorted(({"x": x, "v": v} for x, v in zip(centres, vectors)), key=lambda f: f["x"])

    return _embedded(images, crops, load, [faces], batch, pa.list_(pa.struct([("x", pa.float64()), ("v", pa.list_(pa.float64()))])), "array<struct<x:double,v:array<double>>>", out)


def exif_dates(contents: pa.Array) -> pa.Array:
    return pa.array([exif_date(c) for c in contents.to_pylist()], pa.string())


#: The least side and area of a usable face, the share of its side added around it, and how many faces count.
FACE_SIDE, FACE_AREA, FACE_PAD, FACES = 80, 30_000, 0.25, 4


def face_boxes(faces: Column) -> Column:
    """The up to four largest usable faces (x, y, w, h in pixels; of equal area the leftmost), padded, from left to right."""
    usable = F.filter(faces, lambda f: (f["w"] >= FACE_SIDE) & (f["h"] >= FACE_SIDE) & (f["w"] * f["h"] >= FACE_AREA))
    keyed = F.transform(usable, lambda f: F.struct((-(f["w"] * f["h"])).alias("a"), f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h")))
    best = F.slice(F.array_sort(keyed), 1, FACES)
    padded = F.transform(best, lambda f: F.struct(F.greatest(F.lit(0.0), f["x"] - FACE_PAD * f["w"]).alias("x"), F.greatest(F.lit(0.0), f["y"] - FACE_PAD * f["h"]).alias("y"), (f["w"] * (1 + 2 * FACE_PAD)).alias("w"), (f["h"] * (1 + 2 * FACE_PAD)).alias("h")))
    return F.array_sort(padded)


#: The least area of a face that counts for coverage; the ratio and share of keypoint matches.
COVERED_FACE, MATCH_RATIO, MATCH_SHARE = 12_000, 0.75, 0.62


def face_share(faces: Column, width: Column, height: Column) -> Column:
    """The part of an image that its faces (w, h in pixels) of enough area cover."""
    areas = F.filter(F.transform(faces, lambda f: (f["w"] * f["h"]).cast("double")), lambda a: a >= COVERED_FACE)
    return F.coalesce(F.try_divide(F.aggregate(areas, F.lit(0.0), lambda s, a: s + a), (width * height).cast("double")), F.lit(0.0))


def keypoint_share(a: list[bytes] | None, b: list[bytes] | None) -> float | None:
    """Matches of binary keypoint descriptors over the smaller image's keypoints; null if either has none.

    A match is nearer than MATCH_RATIO times the second nearest. It stands in
    for embeddings where no model can be loaded: from MATCH_SHARE on a pair is alike.
    """
    if not a or not b:
        return None
    x, y = (np.frombuffer(b"".join(d), np.uint8).reshape(len(d), -1) for d in (a, b))
    if len(y) < 2:
        return 0.0
    distance = np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2, dtype=np.int64)
    near = np.partition(distance, 1, axis=1)
    return min(1.0, float((near[:, 0] < MATCH_RATIO * near[:, 1]).sum()) / min(len(x), len(y)))


def keypoint_shares(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([keypoint_share(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


#: The part of a probe document that the metrics come from.
PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,bit_rate:string,duration:string>>,format:struct<duration:string,bit_rate:string>>"


def probe_metrics(document: Column) -> dict[str, Column]:
    """Metrics of a video's probe document (JSON text): of its first video and first audio stream.

    An unusable average frame rate gives way to the real one; the duration to
    frames by rate; the container's bit rate to the stream's.
    """
    doc = F.from_json(document, PROBE)
    first = lambda kind: F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    fps = F.coalesce(coerce.ratio(v["avg_frame_rate"]), coerce.ratio(v["r_frame_rate"]))
    frames = coerce.positive(v["nb_frames"])
    return {
        "duration_sec": F.coalesce(coerce.positive(doc["format"]["duration"]), coerce.positive(v["duration"]), F.try_divide(frames, fps)),
        "fps": fps, "frame_count": frames, "width": v["width"], "height": v["height"],
        "bitrate_kbps": F.coalesce(coerce.positive(doc["format"]["bit_rate"]), coerce.positive(v["bit_rate"])) / 1000,
        "audio_present": F.when(doc.isNotNull(), a.isNotNull()), "video_codec": v["codec_name"], "audio_codec": a["codec_name"],
        "video_metrics_status": F.when(v.isNotNull(), "ok").otherwise("error"),
    }


def composition(faces: Column) -> Column:
    """Score of the largest face (x, y, w, h as shares of the frame, with the image's tilt score); 0 without faces."""
    largest = F.get(F.array_sort(faces, lambda a, b: F.when(a["w"] * a["h"] > b["w"] * b["h"], -1).when(a["w"] * a["h"] < b["w"] * b["h"], 1).otherwise(0)), F.lit(0))
    cx, cy, area = largest["x"] + largest["w"] / 2, largest["y"] + largest["h"] / 2, largest["w"] * largest["h"]
    edge = scores.edge_penalty(largest["x"], largest["y"], largest["w"], largest["h"])
    score = 0.3 * scores.subject_placement(cx, cy) + 0.3 * scores.face_coverage(area) + 0.2 * (1 - edge) + 0.2 * largest["tilt"]
    return F.when(F.coalesce(F.size(faces), F.lit(0)) > 0, score).otherwise(0.0)


def tilt_score(angles: Column) -> Column:
    """1 less twice the lines' mean distance from upright (radians), at least 0; 1 without lines."""
    off = F.transform(angles, lambda t: F.abs(t - np.pi / 2))
    mean = F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / F.size(off)
    return F.when(F.coalesce(F.size(angles), F.lit(0)) > 0, F.greatest(F.lit(0.0), 1 - 2 * mean)).otherwise(1.0)


def with_model(rows: DataFrame, columns: list[str], load: Callable[[], Callable[[list[tuple]], list]], out: str, kind: str, batch: int = 32) -> DataFrame:
    """Rows with a model's output in ``out``: ``load`` runs once per task and gives a function of a batch of tuples.

    A batch that raises is tried row by row; rows that raise get null.
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rb in batches:
            given, results = iter(zip(*(rb.column(rb.schema.get_field_index(c)).to_pylist() for c in columns))), []
            while part := list(islice(given, batch)):
                try:
                    results += model(part)
                except Exception:  # noqa: BLE001  one unreadable file must not lose its batch
                    for row in part:
                        try:
                            results += model([row])
                        except Exception:  # noqa: BLE001
                            results.append(None)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(results)], names=[*rb.schema.names, out])

    return rows.mapInArrow(run, f"{fields}, {out} {kind}")
