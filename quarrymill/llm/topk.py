"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.plans.storage import stored

SCALE = 256
K = 5
#: Rows of a tile of queries, and of a tile of candidates.
QUERY_ROWS, TILE_ROWS = 1024, 4096
#: Components of the queries that are broadcast together.
BLOCK_VALUES = 1 << 22
#: Lists of one query that are merged into one in a round.
FAN = 16
#: Scores lie in -MOST..MOST; ABSENT marks an empty place of a list.
MOST, ABSENT = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Rows with a larger component are multiplied apart where products may pass a long.
LARGE = 1 << 24


def usable(vector: Column) -> Column:
    """True where a vector and all its components are present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _exact(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Products in unbounded integers, held in -MOST..MOST."""
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(tile).T, -MOST, MOST).astype(np.int64)


def products(queries: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, int]:
    """Integer inner products of all rows of two arrays of integral doubles, and a bound on their size.

    The narrowest type that holds every partial sum exactly is used; rows whose
    products may pass a long are multiplied apart, in unbounded integers.
    """
    high = [int(np.abs(x).max(initial=0)) for x in (queries, tile)]
    bound = high[0] * high[1] * max(1, tile.shape[1])
    if bound < 1 << 53:
        exact = np.float32 if bound < 1 << 24 else np.float64
        return (queries.astype(exact) @ tile.astype(exact).T).astype(np.int64), bound
    if bound < 1 << 62 and max(high) < 1 << 62:
        return queries.astype(np.int64) @ tile.astype(np.int64).T, bound
    own, other = (np.abs(x).max(axis=1, initial=0) < LARGE for x in (queries, tile))
    scores = np.empty((len(queries), len(tile)), np.int64)
    scores[~own] = _exact(queries[~own], tile)
    scores[np.ix_(own, ~other)] = _exact(queries[own], tile[~other])
    small = queries[own], tile[other]
    scores[np.ix_(own, other)] = products(*small)[0] if LARGE * LARGE * max(1, tile.shape[1]) < 1 << 62 else _exact(*small)
    return scores, MOST


def tile_top(queries: np.ndarray, query_rows: np.ndarray, tile: np.ndarray, tile_rows: np.ndarray, tile_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (a row per query, up to ``k`` columns, ABSENT where there are fewer) of the best in a tile.

    A query's own row is left out; ties go to smaller ids.
    """
    order = np.argsort(tile_ids, kind="stable")
    tile, tile_rows, tile_ids = tile[order], tile_rows[order], tile_ids[order]
    scores, bound = products(queries, tile)
    scores[query_rows[:, None] == tile_rows[None, :]] = ABSENT
    n = len(tile_ids)
    take = min(k, n)
    if bound < (1 << 62) // n:
        keys = np.where(scores == ABSENT, ABSENT, scores * n + np.arange(n - 1, -1, -1))
        best = np.argpartition(keys, n - take, axis=1)[:, n - take :]
    else:
        best = np.argsort(~scores, axis=1, kind="stable")[:, :take]
    return np.take_along_axis(scores, best, 1), tile_ids[best]


def merge_top(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of two lists a query, ties to smaller ids."""
    scores, ids = np.concatenate([scores, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    best = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _values(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as integral doubles."""
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)


def _packed(queries: pa.Array) -> pa.Array:
    """Lists of query structs (row, id, v) as one binary each: their count, rows, ids and components."""
    out = []
    for one in queries:
        rows = one.values
        parts = [rows.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
        out.append(np.int64(len(rows)).tobytes() + parts[0].astype("<i8").tobytes() + parts[1].astype("<i8").tobytes() + rows.field(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
    return pa.array(out, pa.binary())


def _unpacked(data: bytes, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    rows, ids = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n)
    return rows, ids, np.floor(scale * np.frombuffer(data, "<f8", offset=8 + 16 * n).reshape(n, dim))


_LISTS = "query long, query_id long, part int, best array<struct<neg:long,id:long>>"


def _search(shipped, k: int, scale: int):
    """A task's pass over its candidates, with one running list a query of the broadcast block."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {dim: _unpacked(data, dim, scale) for dim, data in shipped.value}
        lists = {dim: [np.full((len(b[0]), k), ABSENT), np.zeros((len(b[0]), k), np.int64)] for dim, b in blocks.items()}
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in set(np.unique(dims).tolist()) & blocks.keys():
                own = batch.filter(pa.array(dims == dim))
                query_rows, _, queries = blocks[dim]
                scores, ids = lists[dim]
                for at in range(0, len(own), TILE_ROWS):
                    part = own.slice(at, TILE_ROWS)
                    tile_rows, tile_ids = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    tile = _values(part.column(2), dim, scale)
                    for q in range(0, len(queries), QUERY_ROWS):
                        rows = slice(q, q + QUERY_ROWS)
                        found = tile_top(queries[rows], query_rows[rows], tile, tile_rows, tile_ids, k)
                        scores[rows], ids[rows] = merge_top(scores[rows], ids[rows], *found, k)
        for dim, (scores, ids) in lists.items():
            there = scores != ABSENT
            some = there.any(axis=1)
            ends = np.concatenate([[0], np.cumsum(there[some].sum(axis=1))]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(-scores[there]), pa.array(ids[there])], ["neg", "id"])
            part = pa.array(np.full(int(some.sum()), TaskContext.get().partitionId(), np.int32))
            yield pa.record_batch([pa.array(blocks[dim][0][some]), pa.array(blocks[dim][1][some]), part, pa.ListArray.from_arrays(pa.array(ends), entries)], names=["query", "query_id", "part", "best"])

    return searched


def merged_lists(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One list a query: in each round a query's lists are merged FAN at a time, so no task meets more of them."""
    while True:
        parts = -(-parts // FAN)
        both = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.groupBy("query", "query_id", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(both.alias("best"))
        if parts <= 1:
            return lists


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best among all other rows.

    ``is_query`` tells from the id column which rows ask.
    Scores are inner products of floor(scale * x), ties go to smaller ids.
    Vectors that are null or empty, or hold null or non-finite components, and
    rows with a null id take no part; vectors meet only vectors of as many
    components.  Rows that repeat an id are rows of their own, as candidates and
    as queries.  Products are exact; a score beyond a long is given as the
    nearest long, of equal size and sign, and ranks as it.

    Queries are packed in blocks of about BLOCK_VALUES components, a fixed bound
    on what the driver holds and broadcasts at once; every block passes over all
    candidates in place.  A task multiplies tiles of its candidates with tiles of
    the block, selects ``k`` a query in each product and keeps one list a query;
    the tasks' lists are merged in a tree.  Other columns are not read.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") > 0))
    rows = stored(good.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim")), "vectors")
    parts = max(1, rows.rdd.getNumPartitions())
    asked = rows.where(is_query(F.col("id")))
    values = asked.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    blocks = max(1, -(-values // BLOCK_VALUES))
    grouped = asked.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "dim").agg(F.collect_list(F.struct("row", "id", F.col("v").cast("array<double>").alias("v"))).alias("q"))
    packed = stored(grouped.select("block", "dim", F.arrow_udf(_packed, "binary")("q").alias("data")), "queries")
    found = []
    for number in range(blocks):
        block = [(r["dim"], bytes(r["data"])) for r in packed.where(F.col("block") == number).collect()]
        lists = merged_lists(rows.mapInArrow(_search(spark.sparkContext.broadcast(block), k, scale), _LISTS), parts, k)
        ranked = lists.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.neg")).alias("score"))
        found.append(stored(ranked, "top") if blocks > 1 else ranked)
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]
