"""File scans, archives, stages and streams."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import audit, joins
from quarrymill.plans import storage
from quarrymill.plans.stages import StageRunner, environment, guarded_clean
from quarrymill.sources import archives, boxes, cache, files, probes
from quarrymill.streaming import ingest


def test_scan(spark, tmp_path):
    (tmp_path / "al").mkdir()
    for name, text in (("al/a.jpg", "x"), ("al/a.jpg.json", '{"photoTakenTime":{"timestamp":"77"}}'), ("b.MP4", "y"), ("al/lost.json", "{bad"), ("z.zip", "z"), ("al/b.png", "p"), ("al/b.json", "{}")):
        (tmp_path / name).write_text(text)
    raw = files.raw_files(files.listing(spark, str(tmp_path)), str(tmp_path)).cache()
    assert {(r["file_name"], r["file_role"], r["album_path"]) for r in raw.where("file_role != 'sidecar'").collect()} == {("a.jpg", "media/photo", "al"), ("b.MP4", "media/video", ""), ("z.zip", "archive", ""), ("b.png", "media/photo", "al")}
    assert [f.name for f in raw.schema] == [f.name for f in files.RAW_FILES]
    assert files.archives(raw).count() == 1
    sides = {r["path"].rpartition("/")[2]: r["json_datetime"] for r in files.sidecars(spark, str(tmp_path)).collect()}
    assert sides == {"a.jpg.json": "77", "lost.json": None, "b.json": None}
    media = raw.where("file_role like 'media/%'").select("file_path", F.col("album_path").alias("folder"), F.col("file_name").alias("name"), F.regexp_replace("file_name", r"\.[^.]*$", "").alias("stem"))
    side = raw.where("file_role = 'sidecar'").select(F.col("album_path").alias("folder"), F.col("file_name").alias("name"), F.col("file_path").alias("path"))
    linked = joins.sidecars_of(media, side)
    assert {(r["name"], (r["json_path"] or "").rpartition("/")[2]) for r in linked.collect()} == {("a.jpg", "a.jpg.json"), ("b.MP4", ""), ("b.png", "b.json")}
    lost = joins.orphans(side.select("path"), linked.select(F.col("json_path").alias("path")), "path")
    assert [r["path"].rpartition("/")[2] for r in lost.collect()] == ["lost.json"]
    assert {r["metric"]: r["value"] for r in audit.file_counts(raw).collect()}["total_files"] == "7"


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", 'a "b",\nc'), ("n", None)], files.AUDIT)
    files.write_csv(rows, str(tmp_path / "t"), single=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t"), files.AUDIT).collect())) == [("m", 'a "b",\nc'), ("n", None)]
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfmetric,value\nx,00012e5\n")
    assert files.read_csv(spark, str(tmp_path / "bom.csv"), files.AUDIT).first()["value"] == "00012e5"


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "x")
    (tmp_path / "b.rar").write_text("no")
    paths = [str(tmp_path / "a.zip"), str(tmp_path / "b.rar")]
    assert archives.unpack(paths, str(tmp_path / "st")) == (paths[:1], paths[1:])
    assert archives.preflight(paths, "stop", "") == archives.STOP and archives.preflight([], "stop", "") == 0
    with pytest.raises(ValueError):
        archives.preflight(paths, "ask", "")
    with pytest.raises(ValueError):
        archives.preflight(paths, "interactive", "")
    assert archives.preflight(paths, "interactive", "", lambda p: "continue") == 0
    assert archives.preflight(paths, "interactive", "", lambda p: "stop", str(tmp_path / "list")) == archives.STOP and (tmp_path / "list").read_text().split() == paths


def box(kind, *content):
    data = b"".join(content)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def movie(width=64, height=48, frames=50, scale=1000, length=2000, wide=False):
    """A movie header with a video and an audio track, after some media data."""
    header = struct.pack(">B3xQQIQ4x", 1, 0, 0, scale, length) if wide else struct.pack(">B3xIIII4x", 0, 0, 0, scale, length)
    track = lambda kind, code, n: box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", width << 16, height << 16)), box(b"mdia", box(b"mdhd", header), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", bytes(8), box(code, bytes(20))), box(b"stts", struct.pack(">IIIIII", 0, 2, n - 1, 40, 1, 40))))))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(1000)) + box(b"moov", box(b"mvhd", bytes(20)), track(b"vide", b"avc1", frames), track(b"soun", b"mp4a", 90))


def test_video_probes_are_cached_and_fall_back(spark, tmp_path):
    for name, data in (("a.mp4", movie()), ("b.mov", movie(wide=True, frames=20)), ("c.mp4", b"\0\0\0\x10moovxxxxxxxx"), ("d.mp4", b"junk"), ("e.mp4", movie()[:1100])):
        (tmp_path / name).write_bytes(data)
    rows = [(n, str(tmp_path / n), (tmp_path / n).stat().st_size, 1.0, 7) for n in ("a.mp4", "b.mov", "c.mp4", "d.mp4", "e.mp4")] + [("none", str(tmp_path / "none"), 0, 1.0, 7)]
    videos = spark.createDataFrame(rows, "asset_id string, file_path string, file_size long, created_at_fs double, width int")
    calls = str(tmp_path / "calls")

    def preferred(path):
        with open(calls, "a") as f:
            f.write(path + "\n")
        if path.endswith("b.mov"):
            return '{"streams":[{"codec_type":"video","codec_name":"h264","width":5}],"format":{"duration":"3"}}'
        raise ValueError("no " + path[-5:])

    use, cache = [("own", preferred), ("header", boxes.header_document)], str(tmp_path / "cache")
    for _ in range(2):
        got = {r["asset_id"]: r for r in probes.video_metrics(videos, cache, use).collect()}
        a = got["a.mp4"]
        assert (a["duration_sec"], a["fps"], a["frame_count"], a["width"], a["height"], a["video_codec"], a["audio_codec"], a["audio_present"], a["video_metrics_backend"], a["video_metrics_status"]) == (2.0, 25.0, 50.0, 64, 48, "avc1", "mp4a", True, "header", "ok")
        assert a["bitrate_kbps"] == pytest.approx(rows[0][2] * 8 / 2000) and a["video_metrics_error"] is None
        assert (got["b.mov"]["video_metrics_backend"], got["b.mov"]["width"], got["b.mov"]["duration_sec"]) == ("own", 5, 3.0)
        for name in ("d.mp4", "e.mp4", "none"):
            assert (got[name]["video_metrics_status"], got[name]["video_metrics_backend"], got[name]["width"], got[name]["video_metrics_error"]) == ("error", "own", 7, "no " + str(tmp_path / name)[-5:])
        assert got["c.mp4"]["video_metrics_status"] == "error"
    assert sorted(open(calls).read().split()) == sorted(r[1] for r in rows)  # the second run read nothing again
    later = videos.withColumn("created_at_fs", F.lit(2.0)).where("asset_id = 'a.mp4'")
    assert probes.video_metrics(later, cache, use).count() == 1 and len(open(calls).read().split()) == 7
    assert boxes.header_document(rows[1][1]).count("avc1") == 1
    assert [n for n, _ in probes.default_backends()][-1] == "header"


def test_kept_tables_can_be_cleared(spark):
    kept = storage.stored(spark.range(3), "t")
    assert kept.count() == 3 and "/quarrymill/t-" in kept.inputFiles()[0]
    storage.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()


def test_sinks_and_cache_keys(spark, tmp_path):
    rows = spark.createDataFrame([("/b", 1), ("/a", 2)], "file_path string, n long")
    files.write_text(rows, "file_path", str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["/a", "/b"]
    for _ in range(2):
        files.append_manifest(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    keys = {r[0] for r in rows.select(files.cache_key(F.col("file_path"), F.col("n"), F.lit(1.0), "m")).collect()}
    assert len(keys) == 2 and all(len(k) == 40 for k in keys)
    assert files.uncached(rows.withColumn("cache_key", F.col("file_path")), spark.createDataFrame([("/a",)], "cache_key string")).count() == 1


def test_cache_keeps_rows_without_keys_apart(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4), ("q", 5)], "cache_key string, n long")
    seen = []

    def compute(new):
        seen.append(new.count())
        return new.select("cache_key", (F.col("n") * 0 + 7).alias("v"))

    for _ in range(2):
        got = cache.with_cache(rows, str(tmp_path / "c"), "cache_key string, v long", compute)
        assert sorted((r["n"], r["v"], r["cache_key"]) for r in got.collect()) == [(1, 7, "k"), (2, 7, "k"), (3, 7, None), (4, 7, None), (5, 7, "q")]
    assert seen[0::2] == [2, 0] and spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    class Session:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = Context(master), {k.replace("__", "."): v for k, v in conf.items()}

    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(Session(master))
        assert storage.shared_folder(Session(master, spark__checkpoint__dir="hdfs:///c/")) == "hdfs:///c"
    for master in ("local", "local[4]", "local[*]"):
        session = Session(master)
        assert storage.shared_folder(session) == storage.shared_folder(session) == session.sparkContext.folder


def test_only_a_missing_package_is_hidden(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def failing(name, missing):
        def load(wanted, *args, **kwargs):
            if wanted == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(wanted, *args, **kwargs)

        return load

    try:
        for missing in ("corpus_pipeline", "quarrymill.llm"):
            monkeypatch.setattr(builtins, "__import__", failing("corpus_pipeline", missing))
            assert "pipeline" not in importlib.reload(__spark_entry__).queries()
        monkeypatch.setattr(builtins, "__import__", failing("corpus_pipeline", "xxhash"))
        with pytest.raises(ImportError):
            importlib.reload(__spark_entry__)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_stages_resume(spark, tmp_path):
    calls = []

    def stage(name):
        def run(spark, tables):
            calls.append(name)
            return spark.range(len(tables) + 1)

        return name, run

    runner = StageRunner(spark, str(tmp_path / "w"), [stage("a"), stage("b")])
    assert list(runner.run()) == ["a", "b"] and list(runner.run()) == [] and list(runner.run(first="b")) == ["b"]
    assert calls == ["a", "b", "b"]
    with pytest.raises(ValueError):
        guarded_clean(str(tmp_path), str(tmp_path))
    guarded_clean(str(tmp_path / "w"), str(tmp_path))
    assert runner.done() == [] and "PIL" in environment()


def test_stream_dedupe(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("h1", "2024-01-01 00:00:00", 5), ("h1", "2024-01-01 00:00:01", 5), ("h2", "2024-01-01 00:00:02", 7)]
    df = spark.createDataFrame(rows, "sha256 string, t string, file_size long").select("sha256", F.to_timestamp("t").alias("seen_at"), "file_size")
    df.write.parquet(source)
    for _ in range(2):
        ingest.append_to(ingest.first_copies(ingest.asset_stream(spark, source, df.schema)), out, str(tmp_path / "ck")).awaitTermination(120)
        df.where("sha256 = 'h2'").write.mode("append").parquet(source)
    assert sorted(r["sha256"] for r in spark.read.parquet(out).collect()) == ["h1", "h2"]


def test_stream_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "2024-01-01 00:10:00", 5), ("a", "2024-01-01 00:50:00", 7), ("b", "2024-01-01 00:20:00", 1), ("a", "2024-01-01 01:10:00", 2), ("z", "2024-01-01 06:00:00", 9)]
    df = spark.createDataFrame(rows, "source string, t string, file_size long").select("source", F.to_timestamp("t").alias("seen_at"), "file_size")
    df.write.parquet(source)
    counted = ingest.arrivals(ingest.asset_stream(spark, source, df.schema), "source")
    ingest.append_to(counted, out, str(tmp_path / "ck")).awaitTermination(180)
    # a row later than the watermark is dropped, the open windows close
    late = spark.createDataFrame([("a", "2024-01-01 00:30:00", 100), ("z", "2024-01-01 12:00:00", 1)], "source string, t string, file_size long").select("source", F.to_timestamp("t").alias("seen_at"), "file_size")
    late.write.mode("append").parquet(source)
    ingest.append_to(counted, out, str(tmp_path / "ck")).awaitTermination(180)
    got = {(r["source"], r["window"]["start"].hour, r["n"], r["bytes"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 0, 2, 12), ("b", 0, 1, 1), ("a", 1, 1, 2), ("z", 6, 1, 9)}
