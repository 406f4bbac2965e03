"""The photo pipeline over a folder of images, and the index tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import curation, graph, index, order, review, tables, video
from quarrymill.plans import media, videos as video_plan
from tests.test_operators import png


def test_folder_to_plan(spark, tmp_path):
    rng = np.random.default_rng(4)
    blocks = lambda a: np.kron(a, np.ones((8, 8), int))
    a, b = rng.integers(30, 220, (8, 8)), rng.integers(30, 220, (8, 8))
    for album in ("trip", "copy"):
        (tmp_path / "in" / album).mkdir(parents=True)
    write = lambda name, pixels: (tmp_path / "in" / name).write_bytes(png(pixels))
    write("trip/IMG_0001.png", blocks(a))
    write("copy/IMG_0001.png", blocks(a))
    write("trip/IMG_0002.png", np.kron(a, np.ones((16, 16), int)))
    write("trip/IMG_0050.png", blocks(b))
    (tmp_path / "in/copy/IMG_0001.png.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1000"}}))
    (tmp_path / "in/trip/broken.jpg").write_bytes(b"no image")
    raw, assets = media.scan(spark, str(tmp_path / "in"))
    assert raw.count() == 6 and assets.count() == 5
    unique = media.unique_assets(assets)
    rows = {r["file_path"].rpartition("in/")[2]: r for r in unique.collect()}
    assert set(rows) == {"copy/IMG_0001.png", "trip/IMG_0002.png", "trip/IMG_0050.png", "trip/broken.jpg"}
    assert rows["copy/IMG_0001.png"]["json_datetime"] == "1000" and rows["copy/IMG_0001.png"]["copies"] == 2
    photos = index.photo_index(unique)
    assert photos.count() == 3
    groups = media.photo_groups(media.photo_pairs(photos))
    ranked = media.ranked(groups, photos)
    assert [r["file_path"].rpartition("/")[2] for r in ranked.where("is_best").collect()] == ["IMG_0001.png"]
    assert review.scene_labels(ranked).first()["label"] == "1"
    moves = curation.manifest(media.library_plan(ranked, "/lib")).orderBy("entry").collect()
    assert [m["target_path"] for m in moves] == ["/lib/copy/IMG_0001.png", "/lib/copy/IMG_0001.png.json"]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    _, assets = media.scan(spark, str(tmp_path))
    assert assets.count() == 0 and media.photo_groups(media.photo_pairs(index.photo_index(media.unique_assets(assets)))).count() == 0


def test_video_tables(spark):
    assets = spark.createDataFrame(
        [("v1", "/a/VID_100.mp4", "VID_100.mp4", "a", None, "100", 5.0, None, True), ("v2", "/a/VID_101.mov", "VID_101.mov", "a", None, "125", 5.0, None, None), ("v3", "/b/VID_102.mp4", "VID_102.mp4", "b", None, None, None, "video", False), ("p", "/a/x.jpg", "x.jpg", "a", None, None, 1.0, "image", None)],
        "asset_id string, file_path string, file_name string, album_path string, exif_datetime string, json_datetime string, created_at_fs double, mime_type string, is_video boolean",
    )
    videos = index.video_index(assets)
    metrics = spark.createDataFrame([("v1", 2.5, 10, 20), ("v1", 2.5, 10, 20), ("v2", None, 10, 20)], "asset_id string, duration_sec double, width int, height int")
    joined = index.with_video_metrics(videos, metrics)
    assert {(r["asset_id"], r["duration_sec"], r["width"]) for r in joined.collect()} == {("v1", 2.5, 10), ("v2", None, 10), ("v3", None, None)}
    rows = order.positions(index.video_rows(joined), [F.col("album"), F.col("ts").asc_nulls_last(), F.col("num"), F.col("name"), F.col("id")])
    groups = {r["id"]: r["video_group_id"] for r in video.video_groups(rows, video.video_links(rows)).collect()}
    assert groups == {"v1": "v1", "v2": "v1", "v3": "v3"}
    placed = video_plan.grouped(videos, metrics)
    assert {(r["asset_id"], r["video_group_id"], r["video_group_size"]) for r in placed.collect()} == {("v1", "v1", 2), ("v2", "v1", 2), ("v3", "v3", 1)}
    live = spark.createDataFrame([("v1", "p", 0.5, "strong"), ("v1", "q", 0.1, "Strong "), ("v2", "p", 3.0, "probable")], "video_id string, photo_id string, time_gap double, live_photo_status string")
    best = {r["asset_id"]: r for r in video_plan.scored(placed, live).collect()}
    # v1: pixels 1, duration 1, nothing else, less 0.2; v2: pixels 1, duration 0, less 0.1
    assert (best["v1"]["video_score"], best["v2"]["video_score"], best["v3"]["video_score"]) == (0.23, 0.25, 0.0)
    assert [best[v]["best_asset_id"] for v in ("v1", "v2", "v3")] == ["v2", "v2", "v3"] and best["v1"]["best_file"] == "VID_101.mov" and best["v2"]["is_best_video"]
    assert (best["v1"]["live_photo_photo_asset_id"], best["v1"]["time_gap_sec"], best["v3"]["has_live_photo_pair"]) == ("q", 0.1, False)
    shown = video_plan.review(video_plan.scored(placed)).collect()
    assert {(r["group_id"], r["scene_group_size"], r["final_score"], r["content_type_file"], r["media_type"]) for r in shown} == {("v1", 2, 0.43, "video", "video"), ("v1", 2, 0.35, "video", "video"), ("v3", 1, 0.0, "video", "video")}


def test_grouping_photos(spark):
    df = spark.createDataFrame([("/a/x.JPG", "00", 1, 1, "true"), ("/a/x.gif", "00", 1, 1, "true"), ("/a/y.heic", None, 1, 1, "1"), ("/a/z.tiff", "0", None, 1, None)], "file_path string, phash string, width int, height int, is_image string")
    assert [r["file_path"] for r in index.grouping_photos(df).collect()] == ["/a/x.JPG"]
    rows = index.grouping_photos(df.drop("is_image"))
    assert rows.count() == 2 and {"album_path", "created_at_fs", "json_datetime", "exif_datetime"} <= set(rows.columns)
    with pytest.raises(ValueError):
        index.grouping_photos(df.drop("phash"))
    members = spark.createDataFrame([("/a", 1), ("/b", 2)], "file_path string, group_id long")
    assets = spark.createDataFrame([("/a", "z", 1), ("/a", "y", 2)], "file_path string, asset_id string, sidecar_count int")
    got = index.with_asset_columns(members, assets)
    assert {(r["file_path"], r["asset_id"], r["sidecar_count"]) for r in got.collect()} == {("/a", "y", 2), ("/b", None, None)}
    assert index.with_asset_columns(members, assets.drop("file_path")).columns == members.columns
    assert tables.with_nulls(members, {"group_id": "long", "x": "int"}).columns == ["file_path", "group_id", "x"]


def test_index_helpers(spark):
    df = spark.createDataFrame([(1, None, "x")], "asset_id int, b string, _c string")
    assert tables.ordered(df, ["b", "zz"], private=False).columns == ["b", "asset_id"]
    assert tables.with_defaults(df, {"b": "", "n": 0.0}).first().asDict() == {"asset_id": 1, "b": "", "_c": "x", "n": 0.0}
    with pytest.raises(ValueError):
        tables.require(df, ["nope"])
    with pytest.raises(ValueError):
        index.subject_source(None, None)
    metric = spark.createDataFrame([("p", 1.0)], "file_path string, m double")
    paths = spark.createDataFrame([("p", "a1"), ("p", "a1")], "file_path string, asset_id string")
    assert index.with_asset_ids(metric, paths, "m").collect()[0]["asset_id"] == "a1"
    with pytest.raises(ValueError):
        index.with_asset_ids(metric.withColumn("file_path", F.lit("q")), paths, "m")
    one, two = index.split_scores(df, ["b", "q"], ["_c"])
    assert (one.columns, two.columns) == (["asset_id", "b"], ["asset_id", "_c"])
    assert graph.group_ids(spark.createDataFrame([(5, 5), (6, 5), (9, 9)], "node long, component long")).where("node = 9").first()["group_id"] == 2
