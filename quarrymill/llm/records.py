"""Token ids as length-delimited binary records with a separate offset index.

A record file is a row of frames.  A frame is the payload's length (unsigned
64-bit), a masked CRC-32 of those eight bytes, the payload, and a masked CRC-32
of the payload, all little-endian.  A payload is a byte with the width of an id
(2 or 4) and the ids of one document as unsigned integers of that width.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarrymill.llm.pretokens import encoder, vocabulary
from quarrymill.llm.texts import ROWS, bound_batches
from quarrymill.plans.storage import new_path, stored

END = 0
#: A task begins another file beyond so many bytes.
FILE_BYTES = 256 << 20
#: Pre-tokens that a worker remembers here.
MEMO = 500_000
#: Fixed value: what the mask adds to the rotated checksum.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, TAIL.pack(masked_crc(size)), payload, TAIL.pack(masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; ValueError if a length or checksum is wrong."""
    size, check = HEAD.unpack_from(data)
    if check != masked_crc(data[:8]) or len(data) != HEAD.size + size + TAIL.size:
        raise ValueError("record length is damaged")
    payload = data[HEAD.size : HEAD.size + size]
    if TAIL.unpack_from(data, HEAD.size + size)[0] != masked_crc(payload):
        raise ValueError("record payload is damaged")
    return payload


def pack_ids(ids: bytes) -> bytes:
    """32-bit ids as a payload, two bytes wide if all fit."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) > 0xFFFF:
        return b"\x04" + ids
    return b"\x02" + wide.astype("<u2").tobytes()


def unpack_ids(payload: bytes) -> bytes:
    """The 32-bit ids of a payload."""
    if payload[0] == 4:
        return payload[1:]
    return np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes()


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """Writes the record files in ascending id order and returns the stored index.

    The index has (id, part, file, at, size, before, n_tokens): the frame's place
    and the ids that stand before it in its part; parts are in id order.  Each
    attempt of a task writes files of its own name, and the index names those of
    the attempts that Spark committed, so lost executors leave unused files and
    no damage.  Null texts are the end id alone.  Null ids come first; rows that
    repeat an id are ordered by a hash of their text.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary(name)
    # equal rows are told apart by where they were read, so even those of one id and text are dealt over several parts
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("m"))
    kind = dict(source.dtypes)["id"]
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("m")]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = end.to_bytes(4, "little")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, MEMO).encode, TaskContext.get().partitionId()
        before, at, out, file = 0, 0, None, ""
        try:
            for batch in batches:
                for start in range(0, len(batch), ROWS):
                    rows = batch.slice(start, ROWS)
                    found = []
                    for text in rows.column(1).to_pylist():
                        ids = encode(text) + mark
                        if out is None or at > FILE_BYTES:
                            if out:
                                out.close()
                            file, at = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec", 0
                            system, where = _opened(file)
                            system.create_dir(where.rpartition("/")[0], recursive=True)
                            out = system.open_output_stream(where, buffer_size=1 << 20)
                        data = frame(pack_ids(ids))
                        out.write(data)
                        found.append((part, file, at, len(data), before, len(ids) // 4))
                        at, before = at + len(data), before + len(ids) // 4
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                    yield pa.record_batch([rows.column(0), *columns], names=["id", "part", "file", "at", "size", "before", "n_tokens"])
        finally:
            if out:
                out.close()

    index = ordered.mapInArrow(written, f"id {kind}, part int, file string, at long, size long, before long, n_tokens long")
    return stored(index, "record-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before each; one sum per part reaches the driver."""
    sums = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sums)]
    spark = index.sparkSession
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, starts)], "part int, base long")
    return index.join(F.broadcast(bases), "part").select(index.columns + [(F.col("base") + F.col("before")).alias("start")])


def read_records(index: DataFrame) -> DataFrame:
    """The index with ``ids``, read from the files at the given offsets and verified.

    Any order or subset of index rows may be read; neighbours in a file are read
    through one open handle.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in index.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, handle = None, None
        try:
            for batch in batches:
                for start in range(0, len(batch), ROWS):
                    rows, found = batch.slice(start, ROWS), []
                    for file, at, size in zip(*(rows.column(c).to_pylist() for c in ("file", "at", "size"))):
                        if file != last:
                            if handle:
                                handle.close()
                            system, where = _opened(file)
                            handle, last = system.open_input_file(where), file
                        handle.seek(at)
                        found.append(unpack_ids(unframe(handle.read(size))))
                    yield pa.record_batch([*rows.columns, pa.array(found, pa.binary())], names=[*rows.schema.names, "ids"])
        finally:
            if handle:
                handle.close()

    return index.mapInArrow(read, f"{schema}, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, as the written files give them."""
    folder = new_path(docs.sparkSession, "records")
    index = write_records(docs, folder, id_col, text_col, name, end)
    read = read_records(with_starts(index))
    return read.select(F.col("id").alias(id_col), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
