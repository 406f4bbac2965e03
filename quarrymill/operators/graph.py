"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.operators.order import positions
from quarrymill.plans.storage import stored

#: Up to so many stars' edges are joined by one task in memory, without rounds; and edges that a task contracts at a time.
FEW_EDGES, BLOCK_EDGES = 1000, 100_000
#: Up to so many stars' edges a round's minima are joined as they are.
PLAIN_EDGES = 500_000
#: Beyond, a vertex with at least 1/HEAVY of all edges, and more than LEAST, is dealt into SALTS pieces; there are at most HEAVY such.
HEAVY, LEAST, SALTS = 1000, 100, 16


def _with_minimum(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v; about ``total``) with m, the least of u and its neighbours.

    The minimum is a partially aggregated group-by.  Of many edges it comes back
    by a join in which the edges of a vertex with very many neighbours are dealt
    over several tasks; only the names of those vertices, a bounded number, are
    broadcast.
    """
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= PLAIN_EDGES:
        return edges.join(least, "u").select("u", "v", "m")
    hot = (F.col("n") * HEAVY >= total) & (F.col("n") > LEAST)
    heavy = F.broadcast(least.where(hot).select("u", F.lit(True).alias("hot")))
    pieces = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = edges.join(heavy, "u", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    return dealt.join(least.select("u", "m", F.explode(pieces).alias("salt")).hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_minimum(down, total)
    pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return pairs.where("u != v").distinct()


def _plain(vertex):
    """A vertex as a comparable value; structs become tuples."""
    return tuple(map(_plain, vertex.values())) if isinstance(vertex, dict) else vertex


class _Forest:
    """Union-find over vertices; the least vertex of a tree is its root."""

    def __init__(self):
        self.root: dict = {}
        self.given: dict = {}

    def find(self, x):
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, u, v) -> None:
        a, b = _plain(u), _plain(v)
        for key, vertex in ((a, u), (b, v)):
            if key not in self.root:
                self.root[key], self.given[key] = key, vertex
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def batch(self, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        """Each vertex with its tree's root."""
        return pa.record_batch([pa.array(list(self.given.values()), kind), pa.array([self.given[self.find(x)] for x in self.given], kind)], names=names)


def united(block: int | None, names: list[str]):
    """A task's or group's edges as stars, each vertex with its root, in blocks of so many edges (None: in one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, edges, kind = _Forest(), 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.add(u, v)
            edges += len(batch)
            if block and edges >= block:
                yield forest.batch(kind, names)
                forest, edges = _Forest(), 0
        if edges:
            yield forest.batch(kind, names)

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex (of edges u, v without loops) has one root and no root has another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", whole: bool = False) -> DataFrame:
    """``(node, component)`` for every vertex of an edge; component is its least vertex.

    Each task first contracts its own edges to stars, a bounded block at a time.
    Then alternate large-star and small-star steps (Kiveris et al., 2014): the
    rounds grow with the logarithm of the longest path.  Each round is a table
    in the shared folder; only its row count and checksum reach the driver.  At
    most FEW_EDGES edges are joined by one task instead.  Self-loops yield their
    vertex; edges with a null end are ignored.  ``whole``: edges may
    be stars already, so it is first looked whether any round is needed.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    kind = raw.schema["u"].dataType.simpleString()
    given = stored(raw.mapInArrow(united(BLOCK_EDGES, ["u", "v"]), f"u {kind}, v {kind}").distinct(), "edges")
    size = given.count()
    if size <= FEW_EDGES:
        return given.coalesce(1).mapInArrow(united(None, ["node", "component"]), f"node {kind}, component {kind}")
    now, before = given.where("u != v"), None
    while not (whole and before is None and _are_stars(now)):
        now = stored(_small_star(_large_star(now, size), size), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))


def group_ids(members: DataFrame, component: str = "component", group: str = "group_id") -> DataFrame:
    """Numbers components 1..n in the order of their least member."""
    numbered = positions(members.select(component).distinct(), [F.col(component)], group)
    return members.join(numbered.withColumn(group, F.col(group) + 1), component)
