"""Packing token sequences into fixed windows: best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarrymill.llm.pretokens import encoder, vocabulary
from quarrymill.llm.texts import ROWS, bound_batches, give_back

WINDOW = 4096
END = 2
#: Tokens that a task packs together; what it holds in memory is bounded by this and one document.
BLOCK_TOKENS = 2_000_000
#: Bytes of ids that a task hands back at a time.
OUT_BYTES = 1 << 20
#: A window with more padding than this waits for the next block; at the end it is cut into
#: power-of-two sequences, which need none.
SLACK = 16


class CapacityTree:
    """Segment tree over remaining capacities 1..size: which of them some open window has."""

    def __init__(self, size: int):
        self.size = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = self.size + capacity - 1
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that is present; 0 if there is none."""
        count, at = self.count, self.size + need - 1
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return 0
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        return at - self.size + 1


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of item numbers; every item goes to the tightest open window, longest first."""
    tree, open_, windows = CapacityTree(window), [[] for _ in range(window + 1)], []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[item]
        capacity = tree.tightest(need)
        if capacity:
            at = open_[capacity].pop()
            tree.add(capacity, -1)
            windows[at].append(item)
        else:
            capacity, at = window, len(windows)
            windows.append([item])
        if capacity > need:
            open_[capacity - need].append(at)
            tree.add(capacity - need, 1)
    return windows


@dataclass
class _Piece:
    """A run of a document's ids: the ids, the document's number of them, and how many stand before."""

    doc: object
    ids: bytes
    total: int
    start: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4


def _sequences(pieces: list[_Piece], window: int, last: bool) -> tuple[list[list[tuple[_Piece, int]]], list[_Piece]]:
    """(sequences, pieces left over): each sequence lists (piece, offset).

    Sequences nearly fill a window.  The pieces of other windows are left over,
    or, at the end, cut into sequences of powers of two.
    """
    out, rest = [], []
    for items in best_fit_decreasing([p.length for p in pieces], window):
        own = [pieces[k] for k in items]
        fill = sum(p.length for p in own)
        if window - fill <= SLACK:
            sizes = [fill]
        elif last:
            sizes = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        else:
            rest += own
            continue
        room, sequence, offset = sizes.pop(0), [], 0
        for p in own:
            at, length = 0, p.length
            while at < length:
                take = min(length - at, room)
                sequence.append((_Piece(p.doc, p.ids[4 * at : 4 * (at + take)], p.total, p.start + at), offset))
                at, room, offset = at + take, room - take, offset + take
                if not room:
                    out.append(sequence)
                    room, sequence, offset = sizes.pop(0) if sizes else 0, [], 0
    return out, rest


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents, packed: (id, start, length, ids binary, doc_tokens, sequence_id, offset).

    A document is its token ids and the end id.  What fills whole windows is cut
    off first and stands alone; the rests are packed by best-fit decreasing in
    blocks of about ``block_tokens`` tokens, each in the task that read them, so
    nothing is shuffled.  What doesn't fill its window goes on to the next block,
    if that is no more than half a block.  ``ids`` holds a piece's ids as little-endian unsigned
    32-bit integers.  A sequence has at most ``window`` tokens; it is a power of
    two, or at most SLACK short of the window.  Null and empty texts are the end
    id alone.  Ids may be null or repeated: each row is a document of its own.
    Sequence ids are unique in the result.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary(name)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    mark = end.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, id_type = encoder(path).encode, None
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        pieces: list[_Piece] = []
        rows: list[tuple] = []
        tokens = held = 0

        def place(p: _Piece, offset: int) -> None:
            nonlocal held
            held += len(p.ids)
            rows.append((p.doc, p.start, p.length, p.ids, p.total, sequence, offset))

        def emit(most: int) -> Iterator[pa.RecordBatch]:
            """The placed pieces, once they hold more than so many bytes of ids."""
            nonlocal held
            if held > most:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                rows.clear()
                held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pieces, tokens, sequence
            done, rest = _sequences(pieces, window, last)
            if sum(p.length for p in rest) > block_tokens // 2:
                more, rest = _sequences(rest, window, True)
                done += more
            for placed in done:
                for p, offset in placed:
                    place(p, offset)
                sequence += 1
                yield from emit(OUT_BYTES)
            pieces, tokens = rest, sum(p.length for p in rest)
            yield from emit(0)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text) + mark
                    total = len(ids) // 4
                    full = total - total % window
                    for start in range(0, full, window):
                        place(_Piece(doc, ids[4 * start : 4 * (start + window)], total, start), 0)
                        sequence += 1
                        yield from emit(OUT_BYTES)
                    if full < total:
                        pieces.append(_Piece(doc, ids[4 * full :], total, full))
                    tokens += total
                    if tokens >= block_tokens:
                        yield from flush(False)
        if id_type is not None:
            yield from flush(True)
        give_back()  # the worker waits with its memo only while other stages run

    out = source.mapInArrow(packed, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
