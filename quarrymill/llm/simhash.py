"""Near-duplicate documents: SimHash fingerprints and covering LSH."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarrymill.llm.texts import bound_batches, raw_texts, space_blocks
from quarrymill.operators.graph import connected_components
from quarrymill.plans.storage import stored

RADIUS = 3
SHINGLE = 3
SEED = 42
BITS = 64
#: Buckets of at most this many different fingerprints are compared member by member.
BUCKET = 256
#: A fingerprint with at least 1/HEAVY of all rows is joined by broadcast; there are at most HEAVY such.
HEAVY = 1000
#: Up to so many bucket counts, or keys of rows that go, are broadcast.
BROADCAST_ROWS = 100_000
SALTS = 16

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` of which, for any ``radius`` positions, one avoids them all.

    Covering locality-sensitive hashing (Pagh, 2016): position i gets a non-zero
    vector phi(i) of radius+1 bits, and the mask of a non-zero vector v keeps the
    positions with <phi(i), v> odd.  ``radius`` vectors never span all radius+1
    dimensions, so some v is orthogonal to those of any differing positions.
    """
    size = 1 << (radius + 1)
    phi = {b: 1 + k % (size - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if bin(phi[b] & v).count("1") & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingle_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())]
    by_byte = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return counts, len(hashes)


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of one text; zero for null and for texts without words."""
    total, n, tail = np.zeros(BITS, np.int64), 0, []
    short = True
    for words in space_blocks((text or b"").lower()):
        words = tail + words
        if len(words) >= SHINGLE:
            counts, k = _shingle_counts(words)
            total, n, short = total + counts, n + k, False
            tail = words[len(words) - SHINGLE + 1 :]
        else:
            tail = words
    if short and tail:
        total, n = _shingle_counts(tail)
    return int((2 * total > n) @ _WEIGHTS)


def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit values."""
    return pa.array([_signed(fingerprint(t)) for t in raw_texts(texts)], pa.int64())


def bucket_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between a bounded bucket's fingerprints, as index pairs."""
    own = np.array(members, np.int64).view(np.uint64)
    root = list(range(len(own)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(1, len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= radius).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((j, i))
    return links


def _links(buckets: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.array([[{"a": a, "b": b} for a, b in bucket_links(x)] for x in buckets.to_pylist()], kind)


def _keyed(rows: DataFrame, free: dict[int, list[int]], radius: int) -> DataFrame:
    """Each row once for each mask over the bits that are still free on its path."""
    masks = [(p, p * (1 << (radius + 1)) + v + 1, _signed(m)) for p, bits in free.items() for v, m in enumerate(covering_masks(bits, radius))]
    if len(free) == 1:
        own = F.array(*[F.struct(F.lit(n).cast("long").alias("next"), F.lit(m).cast("long").alias("mask")) for _, n, m in masks])
        each = rows.select("p", "k", "fp", "doc", F.explode(own).alias("m")).select("*", "m.next", "m.mask")
    else:  # at most 15 masks for each of at most 15**2 paths, as the third level's buckets are small
        each = rows.join(F.broadcast(rows.sparkSession.createDataFrame(masks, "p long, next long, mask long")), "p")
    return each.select(F.col("next").alias("p"), F.xxhash64("k", "next", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp", "doc")


def _in_shared_buckets(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows whose bucket is counted: by broadcast of few counts, else over salted keys."""
    if counts.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(counts), ["p", "k"])
    salted = counts.select("p", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["p", "k", "salt"])


def fingerprint_links(nodes: DataFrame, bits: int = BITS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst: struct<doc,fp>) that join all fingerprints within ``radius``.

    ``nodes`` has one row (fp, doc) per different fingerprint.  Each table of the
    covering family groups them by their masked bits.  A bucket of at most
    ``bucket`` members gives a spanning forest of its links, so no clique is
    written out.  A larger one is covered again over the bits its mask left
    free; those fall each time, and 8 free bits are at most 256 members, so this
    ends after few levels and no link is lost.
    """
    if bucket < 1 << 8:
        raise ValueError("buckets of fewer than 256 members can't always be split")
    rows, free, links = nodes.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("k"), "fp", "doc"), {0: list(range(bits))}, None
    while True:
        keyed = _keyed(rows, free, radius)
        counts = stored(keyed.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        met = _in_shared_buckets(keyed, counts)
        small = met.where(F.col("n") <= bucket).groupBy("p", "k").agg(F.collect_list(F.struct("doc", "fp")).alias("m"))
        linked = small.select("m", F.explode(F.arrow_udf(_links, "array<struct<a:int,b:int>>")(F.col("m.fp"))).alias("e"))
        found = linked.select(F.element_at("m", F.col("e.a") + 1).alias("src"), F.element_at("m", F.col("e.b") + 1).alias("dst"))
        links = found if links is None else links.union(found)
        paths = [r["p"] for r in counts.where(F.col("n") > bucket).select("p").distinct().collect()]
        if not paths:
            return links
        rows = stored(met.where(F.col("n") > bucket).select("p", "k", "fp", "doc"), "dense")
        left = {p * (1 << (radius + 1)) + v + 1: [b for b in own if not mask >> b & 1] for p, own in free.items() for v, mask in enumerate(covering_masks(own, radius))}
        free = {p: left[p] for p in paths}


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, h, fp, component_id, root, first) per row of ``docs``.

    ``h`` is the text's hash; ``root`` tells whether the fingerprint is its
    component's least vertex, and ``first`` holds the least (id, h) of the rows
    that share the fingerprint; null ids come last.
    """
    bound_batches(docs.sparkSession)
    own = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.arrow_udf(simhash, "long")(F.col(text_col)).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    folded = own.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stored(folded.withColumn("doc", F.struct("first.none", "first.id")), "nodes")
    linked = connected_components(fingerprint_links(nodes.select("fp", "doc")))
    roots = linked.select(F.col("node.fp").alias("fp"), "component")
    root = F.coalesce(F.col("component.fp") == F.col("fp"), F.lit(True))
    named = stored(nodes.join(roots, "fp", "left").select("fp", "n", "first", F.when(F.col("component").isNull(), F.col("doc.id")).otherwise(F.col("component.doc.id")).alias("component_id"), root.alias("root")), "named")
    rows = named.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * HEAVY >= max(rows, 1) + HEAVY
    heavy, light = named.where(is_heavy).drop("n"), named.where(~is_heavy).drop("n")
    common = own.join(F.broadcast(heavy), "fp")
    return common.union(own.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(light, "fp").select(common.columns))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp long, component_id) per row of ``docs``.

    Documents with equal fingerprints, or with fingerprints linked by chains of
    at most ``RADIUS`` differing bits, share a component; it is named by its
    least id, of whatever type ids are.  Texts that are null, empty or blank have
    fingerprint zero.  Rows with a null id take part; a component of such rows
    alone has id null.  Repeated rows stay repeated.  Empty input gives an empty
    result.  Other columns are not read.
    """
    return _judged(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each component: its least id's, of several texts of that id one of the least fingerprint.

    Every row is judged by its own text, so unlinked texts under one id all
    stay, and linked copies under a null id go as others do.  Of rows alike in
    id and text one stays, of different other columns the one of least hash.
    Only narrow keys of the rows that go are joined with the texts: by broadcast
    where they are few, else over a shuffle.
    """
    judged = _judged(docs.select(id_col, text_col), id_col, text_col)
    stays = F.col("root") & F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    counted = judged.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"), stays.alias("_stays")).agg(F.count(F.lit(1)).alias("_n"))
    gone = stored(counted.where("NOT _stays OR _n > 1"), "gone")
    rows, repeated = gone.agg(F.count(F.lit(1)), F.count_if("_stays")).first()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h"))
    kept = docs.join(_small(gone.select("_id", "_h"), rows), same, "left_anti")
    if not repeated:
        return kept
    alike = docs.join(_small(gone.where("_stays").select("_id", "_h"), repeated), same, "left_semi")
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    one = alike.groupBy(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_row"))
    return kept.union(one.select("_row.*"))
