"""Registered face query over the whole table, against a plain version."""

from collections import defaultdict

from quarrymill.plans import registry


def test_every_photo_has_its_faces(spark, sf_dir):
    photos = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        photos[r["l_orderkey"]].append((r["l_partkey"] % 1000, r["l_suppkey"], r["l_quantity"] * 10, r["l_quantity"] * 8))
    want = {}
    for photo, faces in photos.items():
        usable = sorted((-w * h, x, y, w) for x, y, w, h in faces if w >= 80 and h >= 80 and w * h >= 30_000)[:4]
        padded = sorted((max(0, x - 0.25 * w), max(0, y - 0.25 * a / -w), w * 1.5) for a, x, y, w in usable)
        want[photo] = len(padded), ",".join(str(round(w)) for *_, w in padded) if padded else None
    got = registry.face_boxes_top4(spark, sf_dir).collect()
    assert len(got) == len(photos) and {r["l_orderkey"]: (r["faces"], r["widths"]) for r in got} == want
