"""Boundary rows and small fixtures for the curation operators."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import coerce, media, names, scores
from quarrymill.operators import cleanup, curation, dedupe, facts, graph, joins, order, ranking, review, similarity, video


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_fold_copies_keeps_null_keys_apart(spark):
    schema = "asset_id long, sha256 string, path string, file_size long, has_sidecar boolean, sidecar_count int, has_json_time boolean, has_exif_time boolean, content_type string, json_datetime string, exif_datetime string, sidecars array<string>"
    rows = [
        (1, "x", "b", 5, False, 0, False, False, "doc", " ", None, []),
        (2, "x", "c", 9, True, 1, False, False, "people", "7", None, ["s"]),
        (3, "x", "a", 9, True, 1, False, False, "people", None, "e", ["s", "t"]),
        (4, None, "d", 1, False, 0, False, False, "", None, None, []),
        (5, None, "e", 1, False, 0, False, False, None, None, None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["asset_id"]: r.asDict() for r in dedupe.fold_copies(df).collect()}
    assert set(got) == {3, 4, 5}
    assert (got[3]["copies"], got[3]["sidecars"], got[3]["content_type"], got[3]["json_datetime"], got[3]["exif_datetime"]) == (3, ["s", "t"], "people", "7", "e")
    assert got[4]["content_type"] == ""
    assert (got[3]["sidecar_count"], got[3]["json_path"], got[4]["json_path"]) == (2, "s", "")
    # the survivor counts the sidecars of all copies, a copy its own
    pairs = {(r["canonical_asset_id"], r["absorbed_asset_id"], r["canonical_file_path"], r["absorbed_file_path"], r["canonical_sidecar_count"], r["absorbed_sidecar_count"], r["canonical_has_sidecar"], r["absorbed_has_sidecar"], r["dedupe_action"]) for r in dedupe.absorbed_pairs(df).collect()}
    assert pairs == {(3, 1, "a", "b", 2, 0, True, False, "absorbed_into_canonical"), (3, 2, "a", "c", 2, 1, True, True, "absorbed_into_canonical")}
    assert dedupe.fold_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_are_the_reachable_sets(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "PLAIN_EDGES", (0, 10**6, 10**6)[seed])
    monkeypatch.setattr(graph, "LEAST", 1)
    monkeypatch.setattr(graph, "BLOCK_EDGES", (3, 7, 100_000)[seed])
    monkeypatch.setattr(graph, "FEW_EDGES", (0, 0, 10**6)[seed])
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200 + k, 201 + k) for k in range(12)] + [(300, 300), (None, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_few_edges_of_struct_vertices(spark):
    kind = "struct<doc:struct<none:boolean,id:string>,fp:long>"
    v = lambda i, f: ((i is None, i), f)
    df = spark.createDataFrame([(v(None, 1), v(None, -2)), (v("b", 3), v("a", 9)), (v("é", 4), v("b", 3)), (v("z", 5), v("z", 5))], f"src {kind}, dst {kind}")
    got = {(r["node"]["doc"]["id"], r["node"]["fp"]): (r["component"]["doc"]["id"], r["component"]["fp"]) for r in graph.connected_components(df).collect()}
    assert got == {(None, 1): (None, -2), (None, -2): (None, -2), ("b", 3): ("a", 9), ("a", 9): ("a", 9), ("é", 4): ("a", 9), ("z", 5): ("z", 5)}


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_positions_and_lookahead(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.randrange(20)) for k in range(103)]
    df = order.positions(spark.createDataFrame(rows, "id long, album string, ts long"), [F.col("album"), F.col("ts"), F.col("id")])
    ranked = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert {r["id"]: r["pos"] for r in df.collect()} == {r[0]: k for k, r in enumerate(ranked)}
    want = {(a[0], b[0]) for k, a in enumerate(ranked) for b in ranked[k + 1 : k + 8] if a[1] == b[1]}
    got = [(r["l"]["id"], r["r"]["id"]) for r in order.lookahead(df, 7, within="album").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hamming_boundary_and_prefix(spark):
    rows = [("a", "00000000000000ff"), ("b", "00000000000000e0"), ("c", "00000000000000c0"), ("d", "f0000000000000ff"), ("e", None)]
    pairs = similarity.blocked_pairs(spark.createDataFrame(rows, "file_path string, phash string"))
    assert {(r["img1"], r["img2"], r["distance"]) for r in pairs.collect()} == {("a", "b", 5), ("b", "c", 1)}


@pytest.mark.parametrize(("prefix", "distance"), [(4, 5), (1, 12), (0, 3)])
def test_hash_pairs_equal_all_pairs(spark, prefix, distance):
    rng = random.Random(prefix)
    base = [rng.getrandbits(64) for _ in range(6)]
    own = []
    for k in range(90):
        h = base[k % 6]
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        own.append((f"p{k:02d}", f"{h:016x}"))
    own += [(f"q{k:02d}", own[0][1]) for k in range(25)]  # a hash that very many photos share
    df, limits = spark.createDataFrame(own, "file_path string, phash string"), similarity.Limits(prefix=prefix, hash_distance=distance)
    want = {(a[0], b[0], d) for a in own for b in own if a[0] < b[0] and a[1][:prefix] == b[1][:prefix] and (d := (int(a[1], 16) ^ int(b[1], 16)).bit_count()) <= distance}
    got = [(r["img1"], r["img2"], r["distance"]) for r in similarity.blocked_pairs(df, limits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = [(r["img1"], r["img2"]) for r in similarity.class_pairs(df, limits).collect()]
    assert len(classes) == len(set(classes)) < len(want)
    parts = lambda edges: {frozenset(g) for g in united(edges).values()}
    assert parts(classes) == parts([w[:2] for w in want])


def united(edges):
    groups = {}
    for a, b in edges:
        both = groups.get(a, {a}) | groups.get(b, {b})
        for x in both:
            groups[x] = both
    return groups

def test_narrow_bands_are_compared_by_tiles(spark, monkeypatch):
    """A wide distance leaves bands of two or three bits: tiles meet instead, also those of one hash's copies."""
    monkeypatch.setattr(similarity, "TILE", 40)
    monkeypatch.setattr(similarity, "CELLS", 100)
    monkeypatch.setattr(similarity, "PAIRS", 7)
    limits = similarity.Limits(prefix=1, hash_distance=20)
    random.seed(5)
    hashes = [random.getrandbits(62) for _ in range(150)] + [random.getrandbits(60)] * 60
    rows = [(k, f"{h:016x}") for k, h in enumerate(hashes)] + [(900, None), (None, "0" * 16)]
    df = spark.createDataFrame(rows, "id long, phash string")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and a >> 60 == b >> 60 and (a ^ b).bit_count() <= 20}
    found = similarity.blocked_pairs(df, limits, "id")
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    got = [(r["img1"], r["img2"], r["distance"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    links = {(r["node"], r["component"]) for r in graph.connected_components(similarity.class_pairs(df.where("id IS NOT NULL"), limits, "id"), "img1", "img2").collect()}
    assert links == {(r["node"], r["component"]) for r in graph.connected_components(found, "img1", "img2").collect()}


@pytest.mark.parametrize("tile,block", [(8192, 100_000), (40, 100_000), (7, 20)])
def test_links_are_forests_with_the_components_of_the_pairs(spark, monkeypatch, tile, block):
    """Tiles return trees, not pairs; a photo without id links nothing; copies are linked, also in prefixes dealt by pieces."""
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "CELLS", 100)
    monkeypatch.setattr(similarity, "BLOCK_EDGES", block)
    limits = similarity.Limits(prefix=1, hash_distance=12)
    random.seed(7)
    base = [random.getrandbits(62) for _ in range(9)]
    hashes = [random.choice(base) ^ sum(1 << random.randrange(60) for _ in range(random.randrange(9))) for _ in range(120)] + [base[0]] * 40
    rows = [(random.randrange(10**9), f"{h:016x}") for h in hashes]
    far = (1 << 63) + (1 << 24) - 1  # a photo without id lies between two others
    df = spark.createDataFrame([*rows, (1, f"{1 << 63:016x}"), (None, f"{(1 << 63) + (1 << 12) - 1:016x}"), (2, f"{far:016x}"), (3, None)], "id long, phash string")
    pairs = similarity.blocked_pairs(df, limits, "id").select("img1", "img2").collect()
    found = similarity.class_links(df, limits, "id")
    links = found.collect()
    assert len(links) < len(pairs) / 2 if tile > 7 else len(links) < len(pairs)
    groups = lambda edges: {frozenset(g) for g in united(tuple(e) for e in edges).values()}
    assert groups(links) == groups(pairs)
    want = {(x, min(g)) for g in groups(pairs) for x in g}
    for few in (0, 1000):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        assert {(r["node"], r["component"]) for r in graph.connected_components(found, "img1", "img2", whole=True).collect()} == want


def test_stars_need_no_rounds(spark, monkeypatch):
    edges = lambda *rows: spark.createDataFrame(rows, "u long, v long")
    assert graph._are_stars(edges((2, 1), (3, 1), (5, 4)))
    assert not graph._are_stars(edges((2, 1), (3, 2))) and not graph._are_stars(edges((3, 1), (3, 2)))
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    monkeypatch.setattr(graph, "_small_star", lambda *_: 1 / 0)
    got = graph.connected_components(edges((2, 1), (3, 2), (9, 9)).coalesce(1), "u", "v", whole=True).collect()
    assert {(r["node"], r["component"]) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_dots_of_blocked_pairs(spark, monkeypatch):
    """Dots are those of the expression to the last bit; null where a vector is null, holds a null or differs in length."""
    monkeypatch.setattr(similarity, "TILE", 8)
    random.seed(6)
    odd = {0: None, 1: [], 2: [], 3: [1.0, None, 2.0], 4: [0.5] * 6, 5: [float("nan")] * 5}
    rows = [(k, f"{random.getrandbits(4):016x}", odd.get(k, [random.uniform(-1, 1) for _ in range(5)])) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, phash string, v array<float>")
    got = similarity.blocked_dots(df, {"v": "dot"}, similarity.Limits(prefix=2, hash_distance=20), "id")
    side = lambda n: df.select(F.col("id").alias(f"img{n}"), F.col("v").alias(f"v{n}"))
    both = got.join(side(1), "img1").join(side(2), "img2").select("img1", "img2", "dot", similarity.dot(F.col("v1"), F.col("v2")).alias("want")).collect()
    assert {(r["img1"], r["img2"]) for r in both} == {(i, j) for i in range(40) for j in range(i + 1, 40)} and len(both) == 780
    assert [repr(r["dot"]) for r in both] == [repr(r["want"]) for r in both]


@pytest.mark.parametrize("prefix,distance", [(1, 20), (4, 5)])
def test_enriched_pairs_are_those_of_the_joins(spark, monkeypatch, prefix, distance):
    """By tiles and by bands: the columns of both ends as enrich_pairs joins them, nulls too."""
    monkeypatch.setattr(similarity, "TILE", 8)
    monkeypatch.setattr(similarity, "PAIRS", 5)
    random.seed(9)
    rows = [(random.randrange(10**9), f"{random.getrandbits(4) << 40:016x}" if k % 9 else None, random.choice(["a", "b", None]), None if k % 5 == 0 else k) for k in range(40)]
    df, limits = spark.createDataFrame(rows, "file int, phash string, album string, t long"), similarity.Limits(prefix=prefix, hash_distance=distance)
    found = similarity.enriched_pairs(df, {"t": F.col("t"), "phash": F.concat(F.col("album"), F.lit("!")), "x": F.array("t")}, limits, "file")
    pairs = similarity.blocked_pairs(df, limits, "file").select("img1", "img2", "distance")
    want = joins.enrich_pairs(pairs, df.select("file", "t", F.concat(F.col("album"), F.lit("!")).alias("phash"), F.array("t").alias("x")), "file", ["t", "phash", "x"]).select(found.columns)
    assert found.dtypes == want.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() > 100


def test_backgrounds_of_blocked_pairs(spark, monkeypatch):
    """The two best views as the expressions give them; views of zeros or of nothing give NaN and no error."""
    monkeypatch.setattr(similarity, "TILE", 8)
    monkeypatch.setattr(similarity, "PAIRS", 5)
    random.seed(8)
    odd = {0: None, 1: [0.0] * 6, 2: [1.0, 2.0, 0.0, 0.0, 3.0, 4.0], 3: [1.0, None, 2.0, 3.0, 4.0, 5.0], 4: [1.0, None, None, 3.0, 4.0, 5.0], 5: [0.5] * 4}
    rows = [(k, f"{random.getrandbits(4):016x}", odd.get(k, [random.uniform(-1, 1) for _ in range(6)])) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, phash string, v array<float>")
    got = {(r["img1"], r["img2"]): r["background"] for r in similarity.blocked_views(df, "v", (1, 3, 5), 2, similarity.Limits(prefix=2, hash_distance=20), "id").collect()}
    vectors = {k: v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v] for k, _, v in rows}

    def cosine(a, b):
        if None in a or None in b or len(a) != len(b):
            return None
        of = lambda x, y: sum(p * q for p, q in zip(x, y))
        norms = math.sqrt(of(a, a)) * math.sqrt(of(b, b))
        return of(a, b) / norms if norms else math.inf  # the highest, as NaN

    def background(a, b):
        if a is None or b is None:
            return None
        found = sorted((c for at in (0, 2, 4) if (c := cosine(a[at : at + 2], b[at : at + 2])) is not None), reverse=True)[:2]
        return None if len(found) < 2 else sum(found) / 2

    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    for (i, j), value in got.items():
        want = background(vectors[i], vectors[j])
        assert (value is None) == (want is None)
        assert want is None or (math.isnan(value) if want == math.inf else abs(value - want) < 1e-12)


def test_album_candidate_thresholds(spark):
    bits = lambda n: (1 << n) - 1
    rows = [(1, "x", 0.0, 1, 1.0, 0), (2, "x", 120.0, 26, 1.7, bits(40)), (3, "x", 121.0, 500, 1.0, bits(24)), (4, "x", 20000.0, 900, 1.0, bits(24))]
    df = order.positions(spark.createDataFrame(rows, "id long, album string, ts double, seq long, aspect double, bits long"), [F.col("ts")])
    got = {(r["img1"], r["img2"]): (r["clip"], r["background"]) for r in similarity.album_candidates(df).collect()}
    assert got[(1, 2)] == (0.94, 0.88)
    assert got[(1, 3)] == (0.965, None)
    assert (1, 4) not in got


def test_face_similarity_needs_two(spark):
    faces = "array<struct<x:double,v:array<double>>>"
    one, two = [(0.5, [1.0, 0.0])], [(0.9, [0.0, 1.0]), (0.1, [1.0, 0.0])]
    got = values(spark, similarity.face_similarity(F.col("a"), F.col("b")), [(one, two), (two, list(reversed(two))), (None, two)], f"a {faces}, b {faces}")
    assert got == [None, 1.0, None]


def test_decision_veto_and_scopes(spark):
    rows = [(1, 2, 12, 0.99, 0.95, None), (1, 3, 12, 0.91, 0.95, 0.5), (1, 4, 12, 0.90, 0.93, None), (1, 5, 13, 0.90, 0.93, None), (1, 6, 30, 0.97, 0.5, None), (1, 7, 5, None, None, None)]
    df = spark.createDataFrame(rows, "img1 long, img2 long, distance int, sim double, bg double, face double").withColumn("clip", F.lit(0.965)).withColumn("background", F.lit(0.9))
    got = {(r["img2"], r["pair_scope"]) for r in similarity.decisions(df, F.col("sim"), F.col("bg"), F.col("face")).collect()}
    assert got == {(2, "scene"), (2, "strict"), (4, "scene"), (4, "strict"), (6, "scene")}


def test_video_rules(spark):
    def reason(dt, num, left, right, size=10, codec="h", duration=1.0):
        v = "struct<ts:double,num:long,source:string,width:int,height:int,codec:string,duration:double>"
        return values(spark, video.link_reason(), [((0.0, 0, left, 10, 10, "h", 1.0), (None if dt is None else float(dt), num, right, size, 10, codec, duration))], f"l {v}, r {v}")[0]

    assert reason(30, 99, "json", "json") == "close_time" and reason(None, 0, "json", "json") is None
    assert reason(31, 20, "json", "json") == "number_time" and reason(31, 21, "json", "json") is None
    # one file time among the two is no file pair
    assert reason(120, 20, "fs", "json") == "number_time" and reason(120, 6, "json", "fs", size=3) == "number_time"
    assert reason(300, 6, "json", "fs", size=3, codec=" H ") == "number_format" and reason(301, 6, "json", "json") is None
    assert reason(45, 6, "fs", "fs") == "file_time" and reason(46, 6, "fs", "fs") is None and reason(45, 6, "fs", "fs", size=3) is None
    assert reason(300, 6, "json", "json", size=3, codec=None) is None and reason(300, 6, "json", "json", size=0, codec="") is None


def test_live_pairs_boundaries(spark):
    v = spark.createDataFrame([(1, None, "s", 10.0, 4.0), (2, "a", "s", 10.0, 4.1), (3, "a", None, -0.5, 1.0), (4, "a", "s", None, 1.0), (5, "a", "s", 1.0, None)], "id long, album string, stem string, ts double, duration double")
    p = spark.createDataFrame([(5, None, "s", 11.0), (6, None, "s", 15.0), (7, None, "s", 15.01), (8, "a", None, -5.5), (9, "a", None, 4.5), (10, "a", "s", None)], "id long, album string, stem string, ts double")
    pairs = video.live_pairs(v, p)
    assert {(r["video_id"], r["photo_id"], r["live_photo_status"]) for r in pairs.collect()} == {(1, 5, "strong"), (1, 6, "probable"), (3, 8, "probable"), (3, 9, "probable")}
    assert sorted((r["video_id"], r["photo_id"]) for r in video.nearest_live(pairs).collect()) == [(1, 5), (3, 8)]
    linked = video.with_live(v.select(F.col("id").alias("asset_id"), F.lit("old").alias("live_photo_status")), pairs)
    assert {(r["asset_id"], r["live_photo_status"], r["has_live_photo_pair"]) for r in linked.collect()} == {(1, "strong", True), (2, None, False), (3, "probable", True), (4, None, False), (5, None, False)}


def test_live_pairs_of_rows_without_keys_are_no_product(spark):
    rows = spark.range(3000).select("id", F.lit(None).cast("string").alias("album"), F.lit(None).cast("string").alias("stem"), (F.col("id") * 100.0).alias("ts"), F.lit(1.0).alias("duration"))
    pairs = video.live_pairs(rows, rows.drop("duration"))
    assert pairs.count() == 3000
    keys = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in keys and "NestedLoop" not in keys


@pytest.fixture(params=["light", "heavy"])
def hot(request, monkeypatch):
    """Both ways to get a key's facts: by a window, and by a folded row."""
    if request.param == "heavy":
        monkeypatch.setattr(facts, "HEAVY", 2)
        monkeypatch.setattr(facts, "LEAST", 1)
    return request.param


def test_norms_stay_in_unit_range(spark, hot):
    rows = [("a", 0.0), ("a", -2.0), ("b", 4.0), ("b", 1.0), ("b", 2.0), ("b", None), ("c", 3.0), (None, 9.0), (None, 1.0)]
    df = ranking.normalised(spark.createDataFrame(rows, "g string, x double"), "g", {"m": F.col("x")}, {"n": F.col("x")})
    got = {(r["g"], r["x"], r["m"], None if r["n"] is None else round(r["n"], 6)) for r in df.collect()}
    assert got == {("a", -2.0, 0.0, 0.0), ("a", 0.0, 0.0, 1.0), ("b", 1.0, 0.25, 0.0), ("b", 2.0, 0.5, 0.333333), ("b", 4.0, 1.0, 1.0), ("b", None, None, None), ("c", 3.0, 1.0, 0.0), (None, 9.0, None, None), (None, 1.0, None, None)}


def test_facts_of_every_row(spark, hot):
    df = spark.range(60).select("id", F.when(F.col("id") < 50, F.lit("hot")).when(F.col("id") < 58, F.col("id").cast("string")).alias("g"))
    joined = facts.with_facts(df, "g", {"top": F.max("id"), "n": F.count(F.lit(1))})
    assert joined.columns == ["id", "g", "top", "n"]
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()) == (hot == "heavy")
    assert sorted((r["id"], r["top"], r["n"]) for r in joined.collect()) == [(k, 49, 50) if k < 50 else (k, k, 1) if k < 58 else (k, None, None) for k in range(60)]
    assert facts.with_facts(df.limit(0), "g", {"top": F.max("id")}).count() == 0


def test_rows_without_a_group_stay(spark, hot):
    df = spark.createDataFrame([(1, "s", "g", "b"), (2, "s", "h", " a "), (3, "s", "g", "0"), (4, None, "g", "c"), (5, None, None, "d"), (6, None, None, None)], "asset_id long, scene_group_id string, group_id string, content_type_file string")
    sized = {r["asset_id"]: (r["scene_group_size"], r["scene_group_group_count"], r["scene_merge_candidate"]) for r in ranking.scene_sizes(df, "scene_group_id", "group_id").collect()}
    assert sized == {1: (3, 2, True), 2: (3, 2, True), 3: (3, 2, True), 4: (None, None, False), 5: (None, None, False), 6: (None, None, False)}
    tags = {r["asset_id"]: (r["content_type_group"], r["content_type_scene"]) for r in ranking.content_tags(df).collect()}
    assert tags == {1: ("b, c", "a, b"), 2: ("a", "a, b"), 3: ("b, c", "a, b"), 4: ("b, c", "b, c"), 5: ("d", "d"), 6: ("", "")}
    best = {r["asset_id"]: (r["best_asset_id"], r["is_best"]) for r in ranking.mark_best(df.withColumn("score", F.col("asset_id") * 1.0), "group_id", "score", "asset_id").collect()}
    assert best == {1: (4, False), 2: (2, True), 3: (4, False), 4: (4, True), 5: (None, False), 6: (None, False)}
    counts = {r["asset_id"]: r["n"] for r in ranking.group_sizes(df, "group_id", "content_type_file", "n").collect()}
    assert counts == {1: 3, 2: 1, 3: 3, 4: 3, 5: None, 6: None}


def test_best_first_non_null_mixes_rows(spark):
    df = spark.createDataFrame([("g", 1, 0.9, None), ("g", 2, 0.8, "x"), ("g", 3, None, "y")], "g string, id long, score double, c string")
    assert ranking.first_non_null_best(df, "g", "score", "id", ["c"]).first()["c"] == "x"
    assert ranking.best_rows(df, "g", "score", "id").first()["id"] == 1
    assert [r["is_best"] for r in ranking.mark_best(df, "g", "score", "id").orderBy("id").collect()] == [True, False, False]


def test_coercions(spark):
    rows = [("1.5",), ("nan",), ("x",), (None,), ("inf",), ("-2",)]
    assert values(spark, coerce.number(F.col("x")), rows, "x string") == [1.5, None, None, None, None, -2.0]
    assert values(spark, coerce.positive(F.col("x")), rows, "x string") == [1.5, None, None, None, None, None]
    assert values(spark, coerce.truth(F.col("x"), False), [("Yes",), ("0",), ("maybe",), (None,)], "x string") == [True, False, False, False]
    assert values(spark, coerce.sidecar_list(F.col("x")), [('["a","b"]',), ("",), ("0",), ("[broken",), ("p.json",), (None,)], "x string") == [["a", "b"], [], [], ["[broken"], ["p.json"], []]
    assert values(spark, coerce.ratio(F.col("x")), [("30000/1001",), ("0/0",), ("25",), ("a/b",), (None,)], "x string") == [30000 / 1001, None, 25.0, None, None]
    assert values(spark, coerce.fourcc(F.col("x")), [(0x34363248,), (0,)], "x long") == ["H264", None]
    assert values(spark, coerce.json_datetime(F.col("x")), [('{"creationTime":{"timestamp":"9"}}',), ("{bad",), (None,)], "x string") == ["9", None, None]
    assert values(spark, coerce.capture_seconds(F.col("x"), F.col("y"), F.lit(None)), [("1970:01:01 00:01:00", "5"), ("bad", "5"), (None, "x")], "x string, y string") == [60.0, 5.0, 0.0]


def test_names(spark):
    paths = [("C:\\a\\IMG_0012.JPG",), ("/x/y.tar.gz",), ("/x/.hidden",), ("plain",)]
    assert values(spark, names.file_name(F.col("p")), paths, "p string") == ["IMG_0012.JPG", "y.tar.gz", ".hidden", "plain"]
    assert values(spark, names.suffix(F.col("p")), paths, "p string") == ["jpg", "gz", "", ""]
    assert values(spark, names.stem(F.col("p")), paths, "p string") == ["IMG_0012", "y.tar", ".hidden", "plain"]
    assert values(spark, names.file_role(F.col("p")), paths, "p string") == ["media/photo", "archive", "other", "other"]
    assert values(spark, names.last_number(F.col("p")), [("a1b22.x",), ("none",)], "p string") == [22, None]
    assert values(spark, names.numeric_token(F.col("p")), [("a12b345c6789",), ("12",)], "p string") == [345, None]
    assert values(spark, names.album(F.col("p"), "/r"), [("/r/a/b/c.jpg",), ("/r/c.jpg",)], "p string") == ["a/b", ""]


def test_cleanup_rules(spark):
    rows = [
        (1, "g1", "s", True, 5.0), (2, "g1", "s", False, 9.0),
        (3, "g2", "s", True, 5.0), (4, "g2", "t", False, 5.0), (5, "g2", None, False, 4.0), (6, "g2", None, False, None),
        (7, "g3", "s", False, 1.0), (8, "g3", "s", False, 1.0), (9, "g4", "s", True, 1.0),
    ]
    df = spark.createDataFrame(rows, "asset_id long, safe_subgroup string, sha string, has_json boolean, rating double")
    assert {r["asset_id"] for r in cleanup.delete_candidates(df).collect()} == {2, 5}
    assert {r["asset_id"] for r in cleanup.delete_candidates(df, equal=True).collect()} == {2, 4, 5}
    assert cleanup.rating_column(["x", "final_score", "file_size_n"]) == "file_size_n" and cleanup.rating_column(["x"]) is None
    with pytest.raises(ValueError):
        cleanup.rating_column(["x"], "y")
    assert {r["asset_id"] for r in cleanup.delete_candidates(df.withColumn("rating", F.lit(None).cast("double"))).collect()} == {2}


def test_working_frame(spark):
    rows = [
        (" /a/X.JPG ", 5, None, "AB", None, None, None, "7", False), ("/a/x.jpg", 5, "nan", None, 1.0, None, "s.json", "nan", None), ("/a/y.jpg", 6, "", "P", 3.0, 4.0, "0", None, False),
        ("/a/v.mov", 7, None, None, None, None, None, "7", True), ("", 1, "z", None, None, None, None, "1", False),
    ]
    df = spark.createDataFrame(rows, "file_path string, file_size long, sha256 string, phash string, width double, height double, json_path string, group_id string, is_video boolean")
    keys = lambda **how: {r["file_path"]: (r["duplicate_key"], r["comparison_group"], r["has_json"]) for r in cleanup.working_frame(df, **how).collect()}
    auto = keys()
    assert set(auto) == {"/a/X.JPG", "/a/x.jpg", "/a/y.jpg"}
    assert auto["/a/X.JPG"] == ("fallback::x.jpg::5", "group_id::7", False)
    assert auto["/a/x.jpg"] == ("fallback::x.jpg::5", "fallback::x.jpg::5", True)
    assert auto["/a/y.jpg"] == ("strict::p::6::3x4::.jpg", "strict::p::6::3x4::.jpg", False)
    assert keys(mode="group_id")["/a/y.jpg"][1] == "group_id::nan" and keys(mode="exact")["/a/X.JPG"][1] == "fallback::x.jpg::5"
    assert set(keys(videos=True)) == {"/a/X.JPG", "/a/x.jpg", "/a/y.jpg", "/a/v.mov"}
    by_type = df.drop("is_video").withColumn("mime_type", F.when(F.col("file_size") == 5, "VIDEO"))
    assert {r["file_path"] for r in cleanup.working_frame(by_type).collect()} == {"/a/y.jpg", "/a/v.mov"}
    assert {r["file_path"] for r in cleanup.working_frame(df.drop("is_video")).collect()} == {"/a/X.JPG", "/a/x.jpg", "/a/y.jpg"}
    for bad in (lambda: cleanup.working_frame(df, mode="x"), lambda: cleanup.working_frame(df.drop("group_id"), mode="group_id"), lambda: cleanup.working_frame(df.drop("file_size"))):
        with pytest.raises(ValueError):
            bad()


def test_trash(tmp_path):
    for name in ("a/x", "b/x", "c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    paths = [str(tmp_path / n) for n in ("a/x", "b/x", "a/x", "none")] + ["/etc/hostname"]
    dry = cleanup.trash(paths, str(tmp_path / "bin"), str(tmp_path))
    assert dry == {"moved": 2, "missing": 1, "outside": 1} and (tmp_path / "a/x").exists()
    assert cleanup.trash(paths, str(tmp_path / "bin"), str(tmp_path), dry_run=False) == dry
    assert sorted(p.name for p in (tmp_path / "bin").iterdir()) == ["1-x", "x"] and (tmp_path / "c").exists()


def test_plan_and_moves(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "/in/a.jpg", "x\\y", ["/in/a.json"], 0.5)], "asset_id long, group_id long, path string, album string, sidecars array<string>, best_score double")
    plan = curation.curation_plan(df, "/out")
    assert [tuple(r) for r in curation.manifest(plan).orderBy("entry").collect()] == [(1, 0, "primary", "/in/a.jpg", "/out/x/y/a.jpg"), (1, 1, "sidecar", "/in/a.json", "/out/x/y/a.json")]
    src = tmp_path / "a"
    src.write_text("x")
    to, root = str(tmp_path / "t" / "a"), str(tmp_path)
    assert curation.execute([(str(src), to), (str(src) + "no", to), (str(src), "/tmp/../etc/x")], root) == ["planned", "missing_source", "outside"]
    assert curation.execute([(str(src), to)], root, dry_run=False) == ["moved"] and not src.exists()


def test_moves_leave_a_manifest(spark, tmp_path):
    for name in ("a.jpg", "a.json", "b.jpg"):
        (tmp_path / name).write_text(name)
    p = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([(1, 1, p("a.jpg"), "al", [p("a.json"), p("none.json")], 0.5, 9, "people"), (2, 2, p("b.jpg"), "al", [], 0.5, 9, "people")], "asset_id long, group_id long, path string, album string, sidecars array<string>, best_score double, scene_group_id long, content_type_scene string")
    plan = curation.curation_plan(df, p("out"))
    assert {"scene_group_id", "content_type_scene"} <= set(plan.columns)
    assert curation.execute_plan(plan, p("out"), p("log")) == {"planned": 3, "missing_source": 1} and (tmp_path / "a.jpg").exists()
    assert curation.execute_plan(plan, p("out"), p("log"), dry_run=False) == {"moved": 3, "missing_source": 1}
    assert curation.execute_plan(plan, p("out"), p("log"), dry_run=False) == {"missing_source": 4}
    rows = spark.read.parquet(p("log")).where("status = 'moved'").orderBy("asset_id", "entry_kind").collect()
    assert [(r["asset_id"], r["entry_kind"], r["target_path"]) for r in rows] == [("1", "primary", p("out/al/a.jpg")), ("1", "sidecar", p("out/al/a.json")), ("2", "primary", p("out/al/b.jpg"))]
    assert len({r["batch_id"] for r in rows}) == 1 and all(r["timestamp_utc"] for r in rows)


def test_review_tables(spark, tmp_path):
    rows = [(1, 10, str(tmp_path / "b.jpg"), "a1", True, "people, landscape", None, 1200, 100, 50, 0.9, "[]"), (2, 10, str(tmp_path / "a.jpg"), "a2", False, "people", "x", 1000, 100, 50, 0.8, '["%s"]' % (tmp_path / "a.json")), (3, None, "/c.jpg", "a3", True, None, None, 5, 5, 5, 0.1, ""), (4, 11, "/d.jpg", "a4", True, " Document", "", 5, 5, 5, 0.1, "")]
    df = spark.createDataFrame(rows, "group_id long, scene_group_id long, file_path string, asset_id string, is_best boolean, content_type_file string, content_type_scene string, file_size long, width int, height int, final_score double, sidecar_paths string")
    shown = lambda enabled, **how: {(g["display_id"], g["size"], g["common_label"], g["private_label"], g["label"]) for g in review.photo_groups(review.review_table(df), enabled, **how).collect()}
    assert shown(["people"]) == shown(["landscapes"]) == {(10, 2, "10", "1, 2", "10 1, 2")}
    assert shown(["documents"]) == {(11, 1, "11", "4", "11 4")} and shown([]) == set()
    assert shown(["people"], scenes=False) == {(1, 1, "1", "", "1"), (2, 1, "2", "", "2")}
    assert {r["display_id"] for r in review.displayed(df).collect()} == {10, 3, 11}
    found = {(r["display_id"], r["metric"]) for r in review.varying_columns(review.displayed(df), "display_id", ["file_size", "width", "height", "final_score", "content_type_scene"]).collect()}
    assert found == {(10, "file_size"), (10, "final_score"), (10, "content_type_scene"), (10, "size_wh"), (3, "size_wh"), (11, "size_wh")}
    own = review.group_rows(df, 10).collect()
    assert [(r["file_name"], r["is_best"]) for r in own] == [("a.jpg", False), ("b.jpg", True)]
    metrics = [{m["metric"]: (m["raw"], m["text"], m["is_highest"]) for m in r["metrics"]} for r in own]
    assert list(metrics[0])[-1] == "size_wh" and metrics[0]["size_wh"] == (None, "100 × 50 px", False)
    assert metrics[0]["file_size"] == ("1000", "1000 B", False) and metrics[1]["file_size"] == ("1200", "1.2 KB", True)
    assert metrics[1]["content_type_file"][1] == "People, Landscapes" and "width" not in metrics[0]
    assert "sidecar_paths" in metrics[0] and review.group_rows(df, 10, all_metrics=True).first()["metrics"][-1]["metric"] == "size_wh"
    clips = spark.createDataFrame([(101, True), (101, None), (102, False), (103, None), (103, None)], "video_group_id long, is_live boolean")
    assert {(r["video_group_id"], r["has_live"], r["has_regular"]) for r in review.video_review_groups(clips).collect()} == {(101, True, True), (103, False, True)}
    assert review.video_review_groups(clips, single=True).count() == 3 and review.video_review_groups(clips.drop("is_live")).count() == 2
    kept, gone = review.without_ids(df, spark.createDataFrame([("a1",), ("zz",), ("a1",)], "asset_id string"))
    assert kept.count() == 3 and gone.count() == 1
    for name in ("a.jpg", "a.json", "b.jpg"):
        (tmp_path / name).write_text("x")
    rest, counts = review.delete(df, ["a2", "zz", " "], str(tmp_path / "bin"), str(tmp_path), dry_run=False)
    assert counts == {"deleted_assets": 1, "deleted_files": 1, "deleted_sidecars": 1, "outside": 0}
    assert {r["asset_id"] for r in rest.collect()} == {"a1", "a3", "a4"} and not (tmp_path / "a.json").exists() and (tmp_path / "b.jpg").exists()
    assert review.split_label("10 1, 2") == ("10", ["1", "2"]) and set(review.meta()["metricHelp"]) == set(review.METRICS)


def test_null_keys_meet_in_merges(spark):
    base = spark.createDataFrame([(1, None), (2, "k")], "id long, key string")
    metric = spark.createDataFrame([(None, 5.0, 9), ("k", 6.0, 9), ("k", 4.0, 9)], "key string, m double, id long")
    got = {(r["id"], r["m"]) for r in joins.merge_metric(base, metric, "key", F.col("m")).collect()}
    assert got == {(1, 5.0), (2, 4.0)}


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_features(spark, tmp_path):
    x = np.kron(np.random.default_rng(1).integers(0, 256, (8, 8)), np.ones((8, 8), int))
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(png(np.repeat(np.repeat(x, 2, 0), 2, 1)))
    (tmp_path / "c.png").write_bytes(b"no image")
    rows = {r["path"].rpartition("/")[2]: r for r in media.with_image_features(spark.read.format("image").load(str(tmp_path))).collect()}
    assert rows["a.png"]["width"] == 64 and rows["a.png"]["phash"] == rows["b.png"]["phash"]
    assert rows["a.png"]["sharpness"] == pytest.approx(media.laplacian_variance(x.astype(float)))
    assert rows["c.png"]["phash"] is None and rows["c.png"]["width"] is None


def test_exif_and_probe(spark):
    date = b"2020:01:02 03:04:05\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, len(date), 26) + struct.pack("<I", 0) + date
    assert media.exif_date(b"\xff\xd8junkExif\0\0" + tiff) == "2020:01:02 03:04:05"
    assert media.exif_date(b"none") is None and media.exif_date(None) is None and media.exif_date(b"Exif\0\0II") is None
    doc = '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":4,"height":3,"avg_frame_rate":"0/0","r_frame_rate":"25/1","nb_frames":"50","bit_rate":"2000"}],"format":{}}'
    m = spark.createDataFrame([(doc,), ("{bad",)], "d string").select(*[c.alias(n) for n, c in media.probe_metrics(F.col("d")).items()]).collect()
    assert (m[0]["duration_sec"], m[0]["fps"], m[0]["bitrate_kbps"], m[0]["audio_present"], m[0]["video_metrics_status"]) == (2.0, 25.0, 2.0, True, "ok")
    assert m[1]["video_metrics_status"] == "error"


def test_composition_scores(spark):
    assert values(spark, scores.subject_placement(F.col("x"), F.lit(1 / 3)), [(1 / 3,), (1.0,)], "x double") == [1.0, pytest.approx(0.5)]
    assert values(spark, scores.face_coverage(F.col("x")), [(0.025,), (0.2,), (0.55,)], "x double") == [0.5, 1.0, pytest.approx(0.8)]
    face = "array<struct<x:double,y:double,w:double,h:double,tilt:double>>"
    # a face centred 0.35 across and down: placement 1 - 1.5 * |0.35 - 1/3| * sqrt 2, coverage 1 at 0.09, no edge, tilt 0.5
    want = 0.3 * (1 - 1.5 * math.hypot(0.35 - 1 / 3, 0.35 - 1 / 3)) + 0.3 + 0.2 + 0.2 * 0.5
    rows = [([],), (None,), ([(0.0, 0.0, 0.1, 0.1, 0.5), (0.2, 0.2, 0.3, 0.3, 0.5)],), ([(0.0, 0.2, 0.3, 0.3, 0.5)],)]
    assert values(spark, media.composition(F.col("f")), rows, f"f {face}") == [0.0, 0.0, pytest.approx(want), pytest.approx(0.3 * (1 - 1.5 * math.hypot(0.15 - 1 / 3, 0.35 - 1 / 3)) + 0.3 + 0.2 * 0.5)]
    edge = lambda x, w: values(spark, scores.edge_penalty(F.col("x"), F.lit(0.3), F.col("w"), F.lit(0.3)), [(x, w)], "x double, w double")
    assert (edge(0.05, 0.3), edge(0.0499, 0.3), edge(0.5, 0.45), edge(0.5, 0.4501)) == ([0.0], [1.0], [0.0], [1.0])
    assert values(spark, scores.subject_score(F.col("f")), [([],), (None,), ([(0.5, 0.25), (0.1, 0.9)],)], "f array<struct<area:double,center:double>>") == [0.0, 0.0, pytest.approx(0.42)]
    assert values(spark, media.tilt_score(F.col("a")), [([],), (None,), ([math.pi / 2, math.pi / 2 + 0.2],), ([0.0],)], "a array<double>") == [1.0, 1.0, pytest.approx(0.8), 0.0]


def test_lines_and_analysis_size():
    assert media.analysis_size(1920, 960) == (960, 480) and media.analysis_size(5, 7) == (5, 7) and media.analysis_size(1, 10_000) == (1, 960)
    image = np.zeros((400, 300))
    assert media.line_angles(image) == [] and media.for_analysis(image) is image
    image[200:] = 255.0
    assert media.line_angles(image) == [pytest.approx(math.pi / 2)]
    image[:] = 0
    image[:, 150:] = 255.0
    assert media.line_angles(image) == [0.0]
    y, x = np.mgrid[:400, :400]
    found = media.line_angles(np.where(y > x * 0.5, 255.0, 0.0), votes=100)
    assert found and all(abs(t - (math.pi / 2 + math.atan(0.5))) < 0.03 for t in found)
    assert media.for_analysis(np.full((1920, 20), 7.0)).shape == (960, 10) and np.allclose(media.for_analysis(np.full((1920, 20), 7.0)), 7.0)


def test_crops_are_embedded_in_batches(spark, tmp_path):
    for name, n in (("a.png", 100), ("b.png", 40)):
        (tmp_path / name).write_bytes(png(np.tile(np.arange(n) * 2, (n, 1))))
    (tmp_path / "c.png").write_bytes(b"no image")
    images = spark.read.format("image").load(str(tmp_path)).coalesce(1)

    def load():
        def encode(crops):
            assert len(crops) <= 4
            if any(c.shape[:2] == (40, 40) for c in crops) and len(crops) > 4:
                raise ValueError
            return np.array([[c.mean(), 1.0] for c in crops])

        return encode

    rows = {r["path"].rpartition("/")[2]: r["v"] for r in media.view_embeddings(images, load, batch=4).collect()}
    unit = lambda m: [m / math.hypot(m, 1), 1 / math.hypot(m, 1)]
    assert rows["a.png"] == [pytest.approx(unit(m)) for m in (99.0, 99.0, 27.0, 171.0)] and len(rows["b.png"]) == 4 and rows["c.png"] is None
    box = "array<struct<x:double,y:double,w:double,h:double>>"
    faced = images.withColumn("boxes", F.when(F.col("image.width") == 100, F.expr(f"from_json('[{{\"x\":50,\"y\":0,\"w\":10,\"h\":10}},{{\"x\":-5,\"y\":0,\"w\":15,\"h\":10}},{{\"x\":200,\"y\":0,\"w\":5,\"h\":5}}]', '{box}')")))
    found = {r["path"].rpartition("/")[2]: r["v"] for r in media.face_embeddings(faced, load).collect()}
    assert [f["x"] for f in found["a.png"]] == [5.0, 55.0] and found["a.png"][0]["v"] == pytest.approx(unit(9.0)) and found["b.png"] == [] and found["c.png"] is None


def test_model_batches_survive_bad_rows(spark):
    def load():
        def model(rows):
            if any(x == 3 for (x,) in rows):
                raise ValueError
            return [x * 2.0 for (x,) in rows]

        return model

    df = spark.range(6).coalesce(1)
    got = [(r["id"], r["y"]) for r in media.with_model(df, ["id"], load, "y", "double", batch=4).collect()]
    assert got == [(0, 0.0), (1, 2.0), (2, 4.0), (3, None), (4, 8.0), (5, 10.0)]


def test_faces_and_keypoints(spark):
    face = "array<struct<x:double,y:double,w:double,h:double>>"
    rows = [([(100.0, 0.0, 200.0, 200.0), (0.0, 10.0, 200.0, 200.0), (5.0, 5.0, 79.0, 900.0), (9.0, 9.0, 100.0, 110.0)],), ([],), (None,)]
    boxes = values(spark, media.face_boxes(F.col("f")), rows, f"f {face}")
    assert [(b["x"], b["w"]) for b in boxes[0]] == [(0.0, 300.0), (50.0, 300.0)] and boxes[1:] == [[], None]
    assert values(spark, media.face_share(F.col("f"), F.lit(1000), F.lit(1000)), rows, f"f {face}") == [pytest.approx(0.0711 + 0.08), 0.0, 0.0]
    a, b, c = b"\x00" * 32, b"\xff" * 32, b"\x00" * 16 + b"\xff" * 16
    got = values(spark, F.arrow_udf(media.keypoint_shares, "double")(F.col("a"), F.col("b")), [([a, b], [a, b, c]), ([c], [a, b]), ([a], [b]), (None, [a])], "a array<binary>, b array<binary>")
    assert got == [1.0, 0.0, 0.0, None]


def test_content_types(spark):
    rows = [("/a/Screenshot_1.PNG", 10, 10, 0.007), ("/a/cat.png", 10, 10, 0.007), ("/a/IMG_2.png", 10, 10, 0.007), ("/a/screen.jpg", 10, 10, 0.007), ("/a/tall.jpg", 10, 18, None), ("/a/p.jpg", 10, 10, 0.03), ("/screen/x.png", 10, 10, 0.02), ("/a/u.png", None, 10, 0.0), ("/a/z.jpg", 0, 10, 0.0)]
    got = values(spark, names.content_type(F.col("p"), F.col("w"), F.col("h"), F.col("f")), rows, "p string, w int, h int, f double")
    assert got == ["document", "landscape", "document", "landscape", "document", "people", "landscape", None, "landscape"]


def test_times(spark):
    rows = [("5", "7"), ("-5", "7"), ("x", "0"), (None, None)]
    chosen, source = coerce.chosen_time(F.col("a"), F.col("b"))
    assert values(spark, F.struct(chosen, source, coerce.first_time(F.col("a"), F.col("b"))), rows, "a string, b string") == [(5.0, "json", 5.0), (7.0, "fs", -5.0), (None, "missing", 0.0), (None, "missing", None)]
