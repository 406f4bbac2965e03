"""Headers of MP4 and QuickTime files: a probe that needs no program."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: Boxes that hold boxes, and handler types of streams.
NESTED, KINDS = (b"moov", b"trak", b"mdia", b"minf", b"stbl"), {b"vide": "video", b"soun": "audio"}
#: A movie header larger than this isn't read.
MOST = 64 << 20


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes in a range; a broken size ends it."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _movie(file: BinaryIO, length: int) -> bytes | None:
    """The movie box's content; media data is skipped, not read."""
    at = 0
    while at + 8 <= length:
        file.seek(at)
        head = file.read(16)
        size, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            (size,), skip = struct.unpack_from(">Q", head, 8), 16
        elif size == 0:
            size = length - at
        if size < skip:
            return None
        if kind == b"moov":
            file.seek(at + skip)
            return file.read(size - skip) if size <= MOST else None
        at += size
    return None


def _track(data: bytes, start: int, end: int) -> dict:
    """A track's stream as a probe document has it."""
    out: dict = {}
    todo = [(start, end)]
    while todo:
        for kind, a, b in _boxes(data, *todo.pop()):
            if kind in NESTED:
                todo.append((a, b))
            elif kind == b"hdlr" and b - a >= 12:
                out["codec_type"] = KINDS.get(data[a + 8 : a + 12], "other")
            elif kind == b"mdhd" and b - a >= 20:
                wide = data[a] == 1
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
                out["scale"], out["length"] = scale, length
            elif kind == b"stsd" and b - a >= 16:
                out["codec_name"] = data[a + 12 : a + 16].decode("ascii", "replace").strip()
            elif kind == b"stts" and b - a >= 8:
                (n,) = struct.unpack_from(">I", data, a + 4)
                n = min(n, (b - a - 8) // 8)
                out["frames"] = sum(struct.unpack_from(">I", data, a + 8 + 8 * k)[0] for k in range(n))
            elif kind == b"tkhd" and b - a >= 84:
                out["width"], out["height"] = (x >> 16 for x in struct.unpack_from(">II", data, b - 8))
    return out


def header_document(path: str) -> str:
    """A file's probe document (JSON) from its movie header; ValueError without one that names a video stream."""
    length = os.path.getsize(path)
    with open(path, "rb") as file:
        data = _movie(file, length)
    if data is None:
        raise ValueError("no movie header")
    streams, duration = [], 0.0
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"trak":
            continue
        t = _track(data, a, b)
        seconds = t["length"] / t["scale"] if t.get("scale") else 0.0
        stream = {"codec_type": t.get("codec_type"), "codec_name": t.get("codec_name")}
        if stream["codec_type"] == "video":
            stream |= {"width": t.get("width"), "height": t.get("height"), "nb_frames": str(t.get("frames", "")), "duration": str(seconds)}
            if seconds and t.get("frames"):
                stream["avg_frame_rate"] = f"{t['frames'] * t['scale']}/{t['length']}"
        streams.append(stream)
        duration = max(duration, seconds)
    if not any(s["codec_type"] == "video" for s in streams):
        raise ValueError("no video stream")
    rate = {"bit_rate": str(length * 8 / duration)} if duration else {}
    return json.dumps({"streams": streams, "format": {"duration": str(duration), **rate}})
