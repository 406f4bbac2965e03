"""Byte-level text helpers shared by the corpus operators.

Texts arrive as Arrow arrays.  They are handled as UTF-8 bytes because
``bytes.lower`` changes A-Z only and the word classes of the contracts are
byte classes.  A text is walked in blocks, so one very long text never turns
into one very long Python list.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
_SPACE = re.compile(rb"[ \t-\r]")

#: Rows turned into Python objects at a time, and bytes of one text split at a time.
ROWS = 256
BLOCK = 1 << 20


#: Bytes of texts that Spark hands to a Python worker at a time; a longer text comes alone.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch to BATCH_BYTES, so that a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def raw_texts(texts: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text; null stays None."""
    binary = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    for at in range(0, len(binary), ROWS):
        yield from binary.slice(at, ROWS).to_pylist()


def _cuts(text: bytes, boundary: re.Pattern[bytes], size: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            found = boundary.search(text, end)
            end = found.start() if found else n
        yield at, end
        at = end


def word_blocks(lowered: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Words ``[0-9a-z and all non-ASCII]+`` of a lower-cased text, block by block."""
    for at, end in _cuts(lowered, _NOT_WORD, size):
        yield WORD.findall(lowered, at, end)


def space_blocks(lowered: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """White-space separated words of a lower-cased text, block by block."""
    for at, end in _cuts(lowered, _SPACE, size):
        yield lowered[at:end].split()


class TwoGenerations(dict):
    """A bounded memo: when the young half is full it becomes the old half.

    ``memo[key]`` computes and keeps what is missing; what is still in use moves
    back to the young half, so frequent keys survive and rare ones go.  Keys of
    more than KEY characters aren't kept.
    """

    KEY = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > self.KEY:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict[Any, Any] = {}


def give_back() -> None:
    """Returns freed memory to the system: Arrow's, and where it can the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """What this process keeps between tasks under ``key``, made when first asked for.

    One thing is kept at a time: Spark's Python workers live on, and the memo or
    model of one operator would stay while the next one runs.
    """
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]
