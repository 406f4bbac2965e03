"""Look-alike photos: hash joins, neighbourhood joins, embedding decisions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from quarrymill.operators.graph import BLOCK_EDGES, united
from quarrymill.operators.joins import enrich_pairs
from quarrymill.operators.order import lookahead
from quarrymill.plans.storage import stored

#: About so many photos are a tile; two tiles are compared by a task at a time.
TILE = 8192
#: Comparisons, and pairs with their products, that a task holds at once.
CELLS, PAIRS = 1 << 20, 1 << 14
#: Bands of bits are join keys if they leave less than this share of a prefix's pairs; else tiles are compared whole.
SHARE = 0.125
#: The links of a large prefix's copies are dealt into so many pieces.
COPY_PIECES = 64


@dataclass(frozen=True)
class Limits:
    """The thresholds of photo matching."""

    prefix: int = 4
    hash_distance: int = 5
    album_ahead: int = 40
    cross_ahead: int = 20
    near_seconds: float = 120
    near_steps: int = 25
    far_seconds: float = 14400
    far_steps: int = 80
    burst_seconds: float = 5
    burst_steps: int = 15
    cross_seconds: float = 90
    cross_steps: int = 10


LIMITS = Limits()


def hash_bits(hex_hash: Column) -> Column:
    """A 16-digit hex hash as a signed 64-bit value."""
    return F.conv(hex_hash, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_classes(photos: DataFrame, id_col: str = "file_path", phash: str = "phash") -> DataFrame:
    """(bits, id, n): one row per different hash with its least photo and number of photos."""
    keyed = photos.where(F.col(phash).isNotNull()).select(F.col(id_col).alias("id"), hash_bits(F.col(phash)).alias("bits"))
    return keyed.groupBy("bits").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def _pair_columns(d: Column) -> list[Column]:
    return [d.alias("distance"), (1 - d / 64.0).alias("similarity"), F.lit("phash").alias("match_source"), F.lit("strict").alias("pair_scope")]


def _edges(limits: Limits) -> list[int]:
    """Where the ``hash_distance`` + 1 bands of the bits after the prefix begin, and 64."""
    first, parts = 4 * limits.prefix, limits.hash_distance + 1
    return [first + (64 - first) * k // parts for k in range(parts + 1)]


def _banded(limits: Limits) -> bool:
    """Whether bands are wide enough to leave few pairs."""
    edges = _edges(limits)
    return sum(2.0 ** (a - b) for a, b in zip(edges, edges[1:])) < SHARE


def _prefix(limits: Limits) -> Column:
    return F.shiftrightunsigned("bits", 64 - 4 * limits.prefix) if limits.prefix else F.lit(0).cast("long")


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(components, each place's in a row; lengths, -1 for a vector that is null or holds a null)."""
    lists = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((int(lengths.max(initial=0)), len(lists)))
    out[place, row] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    lengths[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    lengths[pc.is_null(lists).to_numpy(zero_copy_only=False)] = -1
    return out, lengths


def _products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.Array:
    """Dots of a's vectors i with b's vectors j, summed from the first component as ``dot`` does."""
    (x, m), (y, n) = a, b
    total = np.zeros(len(i))
    for left, right in zip(x, y):
        total += left[i] * right[j]
    return pa.array(total, mask=(m[i] < 0) | (m[i] != n[j]), from_pandas=False)


def _tiles(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, bool]:
    """A group's two tiles; of a tile that meets itself both are one table."""
    rows = pa.Table.from_batches(list(batches))
    own = rows["x"][0] == rows["y"][0]
    left = rows.filter(pc.equal(rows["t"], rows["x"]))
    return left, left if own else rows.filter(pc.equal(rows["t"], rows["y"])), own


def _near(left: pa.Table, right: pa.Table, own: bool, distance: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the near pairs of two tiles, each pair once."""
    a, b = (side["bits"].to_numpy().view(np.uint64) for side in (left, right))
    strip = max(1, cells // max(1, len(b)))
    for at in range(0, len(a) if len(b) else 0, strip):
        skip = at if own else 0
        near = np.bitwise_count(a[at : at + strip, None] ^ b[None, skip:]) <= distance
        i, j = np.divmod(np.flatnonzero(near), len(b) - skip)
        i, j = i + at, j + skip
        if own:
            later = i < j
            i, j = i[later], j[later]
        yield i, j


def _dots(vectors: list[str]):
    """Measures a pair by a dot per vector column."""

    def of(left: pa.Table, right: pa.Table, own: bool):
        given = [(x := _vectors(left[v]), x if own else _vectors(right[v])) for v in vectors]
        return lambda p, q: [_products(*v, p, q) for v in given]

    return of


def _views(column: pa.ChunkedArray, starts: tuple[int, ...], width: int) -> list[tuple]:
    """``_vectors`` of each slice from a start (1 is the first), and their lengths by the sum of squares."""
    lists, out = column.combine_chunks(), []
    for at in starts:
        x, n = _vectors(pa.chunked_array([pc.list_slice(lists, at - 1, at - 1 + width)]))
        norm = np.zeros(len(lists))
        for place in x:
            norm += place * place
        out.append(((x, n), np.sqrt(norm)))
    return out


def _two_best(cosines: list[pa.Array]) -> pa.Array:
    """Mean of the two highest values of each place; null if fewer aren't null, NaN counts as the highest."""
    given = sum(c.is_valid().to_numpy(zero_copy_only=False).astype(int) for c in cosines)
    best = np.sort([pc.fill_null(c, -np.inf).to_numpy(zero_copy_only=False) for c in cosines], axis=0)[-2:]
    return pa.array((best[1] + best[0]) / 2, mask=given < 2, from_pandas=False)


def _view_scores(column: str, starts: tuple[int, ...], width: int):
    """Measures a pair by the mean of its two best cosines of views."""

    def of(left: pa.Table, right: pa.Table, own: bool):
        a = _views(left[column], starts, width)
        b = a if own else _views(right[column], starts, width)

        def cosine(x, y, p, q):
            dots = _products(x[0], y[0], p, q)
            with np.errstate(invalid="ignore", divide="ignore"):
                return pa.array(dots.fill_null(0.0).to_numpy(zero_copy_only=False) / x[1][p] / y[1][q], mask=dots.is_null().to_numpy(zero_copy_only=False), from_pandas=False)

        return lambda p, q: [_two_best([cosine(x, y, p, q) for x, y in zip(a, b)])]

    return of


def _ends_of(columns: list[str]):
    """Gives a pair both photos' columns: i's, then j's."""

    def of(left: pa.Table, right: pa.Table, own: bool):
        a, b = ([side[c].combine_chunks() for c in columns] for side in (left, right))
        return lambda p, q: [side.take(pa.array(at)) for given, at in ((a, p), (b, q)) for side in given]

    return of


def _compared(distance: int, names: list[str], measure, cells: int, most: int):
    """The near pairs of two tiles, or of one with itself: (i, j, d, and what ``measure`` gives by names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, own = _tiles(batches)
        if not len(left) or not len(right):
            return
        a, b = (side["bits"].to_numpy().view(np.uint64) for side in (left, right))
        ids, others = left["id"].combine_chunks(), right["id"].combine_chunks()
        measured = measure(left, right, own)
        for i, j in _near(left, right, own, distance, cells):
            for k in range(0, len(i), most):
                p, q = i[k : k + most], j[k : k + most]
                d = np.bitwise_count(a[p] ^ b[q]).astype(np.int32)
                yield pa.record_batch([ids.take(pa.array(p)), others.take(pa.array(q)), pa.array(d), *measured(p, q)], names=["i", "j", "d", *names])

    return run


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the trees of i and j; ``root`` holds each place's root, the least place of its tree, before and after."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (up := root[root]).sum() != root.sum():  # roots only fall
            root[:] = up


def _linked(distance: int, cells: int):
    """The trees of two tiles' near pairs, each photo but a root with its root: (p, x, y, img1, img2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, own = _tiles(batches)
        ids = pa.chunked_array([*left["id"].chunks, *([] if own else right["id"].chunks)], left["id"].type).combine_chunks()
        root, shift = np.arange(len(ids)), 0 if own else len(left)
        for i, j in _near(left, right, own, distance, cells):
            _hook(root, i, j + shift)
        leaves = np.flatnonzero(root != np.arange(len(root)))
        if len(leaves):
            keys = [pa.array(np.full(len(leaves), left[c][0].as_py()), left[c].type) for c in ("p", "x", "y")]
            yield pa.record_batch([*keys, ids.take(pa.array(root[leaves])), ids.take(pa.array(leaves))], names=["p", "x", "y", "img1", "img2"])

    return run


def _met(rows: DataFrame, limits: Limits, columns: tuple[str, ...] = ()) -> GroupedData:
    """Rows (id, bits, columns) in a group (p, x, y) for each two tiles of a prefix.

    A prefix's rows are dealt into tiles by hash; each two of its tiles meet in
    one group, so work is spread however many rows share a prefix, and a row is
    copied once per tile of its prefix only.
    """
    keyed = rows.withColumn("p", _prefix(limits))
    sizes = keyed.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 1")  # at most a row per TILE rows
    tiles = F.coalesce("tiles", F.lit(1))
    dealt = keyed.join(F.broadcast(sizes), "p", "left").withColumn("t", F.pmod(F.xxhash64("id", "bits"), tiles).cast("int"))
    met = dealt.withColumn("s", F.explode(F.sequence(F.lit(0), tiles - 1))).select("id", "bits", *columns, "p", F.least("t", "s").alias("x"), F.greatest("t", "s").alias("y"), "t")
    return met.repartition(_width(rows), "p", "x", "y").groupBy("p", "x", "y")


def _width(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tile_pairs(rows: DataFrame, limits: Limits, columns: tuple[str, ...] = (), gives: dict[str, str] | None = None, measure=None) -> DataFrame:
    """(i, j, d, and what ``measure`` gives) of rows (id, bits, columns) of one prefix within the distance, each pair once.

    ``gives`` maps the names to types; without a measure it is a dot per column.
    """
    gives = gives if measure else {v: "double" for v in columns}
    kind = rows.schema["id"].dataType.simpleString()
    out = ", ".join([f"i {kind}, j {kind}, d int", *[f"`{name}` {type_}" for name, type_ in gives.items()]])
    return _met(rows, limits, columns).applyInArrow(_compared(limits.hash_distance, list(gives), measure or _dots(list(columns)), CELLS, PAIRS), out)


def _near_hashes(classes: DataFrame, limits: Limits) -> DataFrame:
    """(a, b, d): different hashes of one prefix within the distance, each pair once; by tiles if bands are narrow."""
    if _banded(limits):
        return _band_pairs(classes, limits)
    whole = classes.select(F.struct("bits", "id").alias("id"), "bits")
    return _tile_pairs(whole, limits).select(F.col("i").alias("a"), F.col("j").alias("b"), "d")


def _band_pairs(classes: DataFrame, limits: Limits) -> DataFrame:
    """As ``_near_hashes``, by bands.

    The prefix and one of ``hash_distance`` + 1 parts of the other bits are the
    join key: of so many parts some part is equal.  So a prefix that very many
    hashes share is joined in small pieces, and a pair that meets in several
    parts is kept from the first.
    """
    edges, parts = _edges(limits), limits.hash_distance + 1
    # bits in the order of the hex text, the highest first
    part = lambda bits, k: F.shiftrightunsigned(F.shiftleft(bits, edges[k]), 64 - edges[k + 1] + edges[k]) if edges[k + 1] > edges[k] else F.lit(0).cast("long")
    bands = F.array(*[F.struct(F.lit(k).alias("k"), part(F.col("bits"), k).alias("v")) for k in range(parts)])
    keyed = classes.select("bits", "id", _prefix(limits).alias("p"), F.explode(bands).alias("band"))
    l, r = keyed.alias("l"), keyed.alias("r")
    d = hamming(F.col("l.bits"), F.col("r.bits"))
    earlier = F.lit(False)
    agreed = [part(F.col("l.bits"), k) == part(F.col("r.bits"), k) for k in range(parts)]
    for k in range(parts - 1):
        earlier |= (F.col("l.band.k") > k) & agreed[k]
    met = l.join(r, (F.col("l.p") == F.col("r.p")) & (F.col("l.band.k") == F.col("r.band.k")) & (F.col("l.band.v") == F.col("r.band.v")) & (F.col("l.bits") < F.col("r.bits")) & (d <= limits.hash_distance) & ~earlier)
    return met.select(F.struct("l.bits", "l.id").alias("a"), F.struct("r.bits", "r.id").alias("b"), d.alias("d"))


def class_pairs(photos: DataFrame, limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """(img1, img2, distance, ...) of the least photos of near hashes, and of each photo with the least of its own hash.

    It joins the same photos as ``blocked_pairs`` with far fewer rows where many
    share a hash: components over both are equal.
    """
    classes = stored(hash_classes(photos, id_col), "hash-classes")
    least, most = F.least("a.id", "b.id").alias("img1"), F.greatest("a.id", "b.id").alias("img2")
    near = _near_hashes(classes, limits).select(least, most, *_pair_columns(F.col("d")))
    own = photos.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("img2"), hash_bits(F.col("phash")).alias("bits"))
    same = own.join(classes.where("n > 1").select("bits", F.col("id").alias("img1")), "bits").where("img1 < img2")
    return near.union(same.select("img1", "img2", *_pair_columns(F.lit(0))))


def class_links(photos: DataFrame, limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """(img1, img2): edges with the components of ``class_pairs``, for grouping only.

    Where tiles are compared, each two of them return a spanning forest instead
    of their pairs: a row at most for each photo.  The edges of a prefix lie in
    one task as far as that contracts them in one block (so its components
    mostly come out whole), those of larger prefixes by pieces.
    """
    if _banded(limits):
        return class_pairs(photos, limits, id_col).select("img1", "img2")
    named = photos.where(F.col(id_col).isNotNull())
    classes = stored(hash_classes(named, id_col), "hash-classes").withColumn("p", _prefix(limits))
    most = F.count(F.lit(1)) * F.ceil(F.count(F.lit(1)) / TILE) + F.sum("n")  # edges of a prefix
    large = classes.groupBy("p").agg(most.alias("edges")).where(F.col("edges") > BLOCK_EDGES).select("p", F.lit(True).alias("large"))  # at most a row per TILE photos
    kind = classes.schema["id"].dataType.simpleString()
    near = _met(classes.select("id", "bits"), limits).applyInArrow(_linked(limits.hash_distance, CELLS), f"p long, x int, y int, img1 {kind}, img2 {kind}")
    own = named.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("img2"), hash_bits(F.col("phash")).alias("bits"))
    same = own.join(classes.where("n > 1").select("bits", "p", F.col("id").alias("img1")), "bits").where("img1 < img2")
    edges = near.union(same.select("p", F.pmod(F.xxhash64("img2"), F.lit(COPY_PIECES)).cast("int"), F.lit(-1), "img1", "img2"))
    piece = [F.when(F.col("large"), F.col(c)).alias(c) for c in ("x", "y")]
    dealt = edges.join(F.broadcast(large), "p", "left").select("img1", "img2", "p", *piece)
    trees = dealt.repartition(_width(photos), "p", "x", "y").groupBy("p", "x", "y").applyInArrow(united(BLOCK_EDGES, ["img1", "img2"]), f"img1 {kind}, img2 {kind}")
    return trees.where("img1 != img2")


def blocked_pairs(photos: DataFrame, limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """(img1, img2, distance, similarity, match_source, pair_scope) of photos (id, phash) that share a hash prefix and are near.

    Hashes are folded to classes and joined first; only near classes are written
    out as pairs of photos.  Where bands are too narrow to be keys, photos are
    compared by tiles instead.  Where very many photos share a hash, that output
    is quadratic by its definition: use ``class_pairs`` for grouping.
    """
    if not _banded(limits):
        return blocked_dots(photos, {}, limits, id_col)
    members = photos.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("id"), hash_bits(F.col("phash")).alias("bits"))
    classes = hash_classes(photos, id_col)
    near = _near_hashes(classes, limits).select(F.col("a.bits").alias("x"), F.col("b.bits").alias("y"), "d")
    same = classes.where("n > 1").select(F.col("bits").alias("x"), F.col("bits").alias("y"), F.lit(0).alias("d"))
    a, b = members.select(F.col("id").alias("i"), F.col("bits").alias("x")), members.select(F.col("id").alias("j"), F.col("bits").alias("y"))
    pairs = near.union(same).join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("i") < F.col("j")))
    return pairs.select(F.least("i", "j").alias("img1"), F.greatest("i", "j").alias("img2"), *_pair_columns(F.col("d")))


def blocked_dots(photos: DataFrame, dots: dict[str, str], limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """``blocked_pairs`` with the dots of both photos' vectors: ``dots`` maps array columns to names of their dots.

    Pairs are found and multiplied where their tiles meet, so no vector is
    copied to its pairs.  A dot is null if a vector is null, holds a null, or
    both differ in length.
    """
    rows = photos.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("id"), hash_bits(F.col("phash")).alias("bits"), *[F.col(v).alias(name) for v, name in dots.items()])
    pairs = _tile_pairs(rows, limits, tuple(dots.values())).where("i != j")
    return pairs.select(F.least("i", "j").alias("img1"), F.greatest("i", "j").alias("img2"), *_pair_columns(F.col("d")), *dots.values())


def enriched_pairs(photos: DataFrame, columns: dict[str, Column], limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """(img1, img2, distance) of ``blocked_pairs`` with both photos' columns, suffixed _1 and _2 as ``enrich_pairs`` gives them.

    Where tiles are compared, they bring the columns along, so the pairs are
    joined with no table.
    """
    if _banded(limits):
        pairs = blocked_pairs(photos, limits, id_col).select("img1", "img2", "distance")
        return enrich_pairs(pairs, photos.select(F.col(id_col).alias("_id"), *[c.alias(name) for name, c in columns.items()]), "_id", list(columns)).select("img1", "img2", "distance", *[f"{name}_{n}" for n in (1, 2) for name in columns])
    inner = {name: f"c{k}" for k, name in enumerate(columns)}
    rows = photos.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("id"), hash_bits(F.col("phash")).alias("bits"), *[c.alias(inner[name]) for name, c in columns.items()])
    gives = {f"{c}_{side}": rows.schema[c].dataType.simpleString() for side in "ij" for c in inner.values()}
    pairs = _tile_pairs(rows, limits, tuple(inner.values()), gives, _ends_of(list(inner.values()))).where("i != j")
    first = F.col("i") < F.col("j")
    ends = [F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}")).alias(f"{name}_{n}") for n, a, b in ((1, "i", "j"), (2, "j", "i")) for name, c in inner.items()]
    return pairs.select(F.least("i", "j").alias("img1"), F.greatest("i", "j").alias("img2"), F.col("d").alias("distance"), *ends)


def blocked_views(photos: DataFrame, vector: str, starts: tuple[int, ...], width: int, limits: Limits = LIMITS, id_col: str = "file_path") -> DataFrame:
    """``blocked_pairs`` with background: the mean of the two best cosines of slices of both photos' vectors.

    Only the vector goes to the tiles; slices are scaled and judged there.  A
    slice of zeros, or none, has no cosine: the background is NaN.
    """
    rows = photos.where(F.col("phash").isNotNull()).select(F.col(id_col).alias("id"), hash_bits(F.col("phash")).alias("bits"), F.col(vector).alias("v"))
    pairs = _tile_pairs(rows, limits, ("v",), {"background": "double"}, _view_scores("v", starts, width)).where("i != j")
    return pairs.select(F.least("i", "j").alias("img1"), F.greatest("i", "j").alias("img2"), *_pair_columns(F.col("d")), "background")


def _gaps(limits: Limits) -> dict[str, Column]:
    seq = F.abs(F.col("l.seq") - F.col("r.seq"))
    la, ra = F.col("l.aspect"), F.col("r.aspect")
    return {
        "dt": F.abs(F.col("l.ts") - F.col("r.ts")),
        "dseq": seq,
        "d": hamming(F.col("l.bits"), F.col("r.bits")),
        "daspect": F.abs(la - ra),
    }


def without_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that aren't yet an undirected edge."""
    key = lambda df: df.select("*", F.least("img1", "img2").alias("_a"), F.greatest("img1", "img2").alias("_b"))
    return key(pairs).join(key(edges).select("_a", "_b"), ["_a", "_b"], "left_anti").drop("_a", "_b")


def _ends() -> list[Column]:
    return [F.col("l.id").alias("img1"), F.col("r.id").alias("img2")]


def local_pairs(photos: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Hash pairs among an album's next rows that are near in time or number.

    ``photos`` has id, pos (in album order), album, ts, seq, aspect, bits.
    """
    g = _gaps(limits)
    near = (g["dt"] <= limits.near_seconds) | F.coalesce(g["dseq"] <= limits.near_steps, F.lit(False))
    found = lookahead(photos, limits.album_ahead, within="album").where(near & (g["d"] <= limits.hash_distance))
    return found.select(*_ends(), g["d"].alias("distance"), (1 - g["d"] / 64.0).alias("similarity"), F.lit("phash_local").alias("match_source"), F.lit("strict").alias("pair_scope"))


def album_candidates(photos: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(img1, img2, distance, clip, background): pairs for the embedding test, with the thresholds that their gaps earn."""
    g = _gaps(limits)
    dseq = F.coalesce(g["dseq"], F.lit(1 << 40))
    close = (g["dt"] <= limits.near_seconds) & (dseq <= limits.near_steps)
    burst = (g["dt"] <= limits.burst_seconds) & (dseq <= limits.burst_steps) & (g["d"] <= 18)
    most = F.when(close, 40).otherwise(24)
    most = F.when(burst, F.greatest(most, F.lit(18))).otherwise(most)
    shape = F.when(close, 0.75).otherwise(0.12)
    clip = F.when(burst, 0.95).when(close, 0.94).otherwise(0.965)
    background = F.when(burst, 0.90).when(close, 0.88)
    reach = (g["dt"] <= limits.far_seconds) | (dseq <= limits.far_steps)
    keep = reach & F.coalesce(g["daspect"] <= shape, F.lit(True)) & (g["d"] > limits.hash_distance) & (g["d"] <= most)
    found = lookahead(photos, limits.album_ahead, within="album").where(keep)
    return found.select(*_ends(), g["d"].alias("distance"), clip.alias("clip"), background.cast("double").alias("background"))


def cross_candidates(photos: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Candidates of different albums among the next rows in time; ``pos`` is the order of time over all albums."""
    g = _gaps(limits)
    keep = (~F.col("l.album").eqNullSafe(F.col("r.album"))) & (g["dt"] <= limits.cross_seconds) & (g["dseq"] <= limits.cross_steps) & F.coalesce(g["daspect"] <= 0.12, F.lit(True)) & (g["d"] > limits.hash_distance) & (g["d"] <= 18)
    found = lookahead(photos, limits.cross_ahead).where(keep)
    return found.select(*_ends(), g["d"].alias("distance"), F.lit(0.90).alias("clip"), F.lit(0.86).alias("background"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to length one."""
    norm = F.sqrt(dot(v, v))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def top_two_mean(*xs: Column) -> Column:
    """Mean of the two highest values."""
    best = F.slice(F.sort_array(F.array(*xs), False), 1, 2)
    return (best[0] + best[1]) / 2


def face_similarity(a: Column, b: Column) -> Column:
    """Mean dot of faces paired from left to right; null if either photo has fewer than two."""
    k = F.least(F.size(a), F.size(b))
    by_x = lambda faces: F.array_sort(faces, lambda p, q: F.when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).otherwise(0))
    dots = F.zip_with(F.slice(by_x(a), 1, F.greatest(k, F.lit(0))), F.slice(by_x(b), 1, F.greatest(k, F.lit(0))), lambda p, q: dot(p["v"], q["v"]))
    return F.when(k >= 2, F.aggregate(dots, F.lit(0.0), lambda s, x: s + x) / k)


def decisions(pairs: DataFrame, sim: Column, bg: Column, face: Column) -> DataFrame:
    """Pairs with their scopes exploded: scene, and strict where the background agrees.

    A scene needs the similarity threshold, or one of two bridges of background
    and hash; unlike faces before a like background veto it.
    """
    d = F.col("distance")
    bridge = ((bg >= 0.93) & (d <= 12) & (sim >= 0.90)) | ((bg >= 0.90) & (d <= 28) & (sim >= 0.91))
    scene = F.coalesce((sim >= F.col("clip")) | bridge, F.lit(False))
    veto = F.coalesce((bg >= 0.90) & (sim <= 0.975) & (d <= 22) & (face < 0.88), F.lit(False))
    scene &= ~veto
    strict = scene & F.coalesce(bg >= F.col("background"), F.col("background").isNull())
    scopes = F.filter(F.array(F.when(scene, F.lit("scene")), F.when(strict, F.lit("strict"))), lambda s: s.isNotNull())
    return pairs.withColumn("similarity", sim).withColumn("pair_scope", F.explode(scopes))
