"""The registered queries of the curation operators, and their SQL.

The driver's tables stand in for media: documents for assets (labels for their
sidecars), embeddings for photos (sign bits for the perceptual hash, label for
the album), events for videos, pages for files, lineitem for scored members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymill.functions import coerce, media, names, scores
from quarrymill.operators import audit, cleanup, curation, dedupe, graph, index, joins, order, ranking, review, similarity, tables, video
from quarrymill.plans import videos as video_plan
from quarrymill.plans.storage import stored
from quarrymill.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


# ---------------------------------------------------------------- assets


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as assets; a label row is an asset's sidecar."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", "source", "n_chars")
    sides = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("side")).distinct()
    has = F.coalesce("side", F.lit(False))
    return docs.join(sides, "doc_id", "left").select(
        F.col("doc_id").alias("asset_id"), "sha256", F.col("doc_id").alias("path"), F.col("n_chars").alias("file_size"), has.alias("has_sidecar"), has.cast("int").alias("sidecar_count"),
        (F.col("lang") == "en").alias("has_json_time"), F.lit(False).alias("has_exif_time"), F.col("source").alias("content_type"), F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("json_datetime"),
        F.lit(None).cast("string").alias("exif_datetime"), F.when(has, F.array(F.concat(F.col("doc_id").cast("string"), F.lit(".json")))).otherwise(F.array().cast("array<string>")).alias("sidecars"),
    )


_ASSETS = """
    WITH a AS (
        SELECT doc_id AS asset_id, sha256(text) AS sha256, n_chars AS file_size, lang, source,
               doc_id IN (SELECT doc_id FROM labels) AS has_sidecar FROM documents),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY has_sidecar DESC, (lang = 'en') DESC, file_size DESC, asset_id) AS rn,
               count(*) OVER (PARTITION BY sha256) AS copies FROM a)
"""


@query(_ASSETS + """,
    g AS (
        SELECT sha256, max(copies) AS copies, bool_or(has_sidecar) AS has_sidecar, CAST(count_if(has_sidecar) AS INTEGER) AS sidecar_count,
               string_agg(CASE WHEN has_sidecar THEN asset_id || '.json' END, '|' ORDER BY asset_id) AS sidecars, min(CASE WHEN has_sidecar THEN asset_id END) AS first_side,
               CAST(min(CASE WHEN lang = 'en' THEN asset_id END) AS VARCHAR) AS json_datetime FROM r GROUP BY sha256),
    m AS (
        SELECT sha256, source, row_number() OVER (PARTITION BY sha256 ORDER BY count(*) DESC, min(asset_id)) AS k FROM a GROUP BY sha256, source)
    SELECT g.sha256, r.asset_id, g.copies, g.has_sidecar, g.sidecar_count, coalesce(g.sidecars, '') AS sidecars, coalesce(first_side || '.json', '') AS json_path, m.source AS content_type, g.json_datetime
    FROM g JOIN r ON r.sha256 = g.sha256 AND r.rn = 1 JOIN m ON m.sha256 = g.sha256 AND m.k = 1""")
def exact_dedupe_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fold_copies(assets(spark, sf_dir)).withColumn("sidecars", F.array_join("sidecars", "|")).drop("exif_datetime")


@query(_ASSETS + """, u AS (SELECT sha256, CAST(count_if(has_sidecar) AS INTEGER) AS sides FROM a GROUP BY sha256)
    SELECT c.asset_id AS canonical_asset_id, r.asset_id AS absorbed_asset_id, r.sha256, c.asset_id AS canonical_file_path, r.asset_id AS absorbed_file_path, sides AS canonical_sidecar_count, CAST(r.has_sidecar AS INTEGER) AS absorbed_sidecar_count,
           sides > 0 AS canonical_has_sidecar, r.has_sidecar AS absorbed_has_sidecar, 'absorbed_into_canonical' AS dedupe_action
    FROM r JOIN r c ON c.sha256 = r.sha256 AND c.rn = 1 JOIN u ON u.sha256 = r.sha256 WHERE r.rn > 1""")
def exact_dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.absorbed_pairs(assets(spark, sf_dir))


@query("""SELECT source, lang AS content_type FROM (
    SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS k FROM documents WHERE trim(lang) <> '' GROUP BY source, lang) WHERE k = 1""")
def content_type_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("content_type"), "doc_id")
    return dedupe.first_mode(docs, "source", "content_type", "doc_id")


@query("""SELECT o_orderkey, o_totalprice, l.l_quantity AS quantity FROM orders LEFT JOIN (
    SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity DESC, l_partkey) AS rn FROM lineitem) l ON l.l_orderkey = o_orderkey AND l.rn = 1""")
def merge_metric_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    metric = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.col("l_quantity").alias("quantity"), "l_linenumber", "l_partkey")
    return joins.merge_metric(base, metric, "o_orderkey", F.col("l_linenumber"), F.col("quantity").desc(), F.col("l_partkey")).select("o_orderkey", "o_totalprice", "quantity")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def linked_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.linked(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


_ROLE = "CASE WHEN contains(url, '.html') THEN 'html' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END"


def _page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(F.when(F.contains(url, F.lit(".html")), "html").when(F.contains(url, F.lit("?")), "query").otherwise("plain").alias("file_role"))


@query(f"""WITH c AS (SELECT {_ROLE} AS role FROM pages)
    SELECT 'total_files' AS metric, CAST(count(*) AS VARCHAR) AS value FROM c UNION ALL SELECT 'files_' || role, CAST(count(*) AS VARCHAR) FROM c GROUP BY role""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.file_counts(_page_roles(spark, sf_dir))


@query(f"""WITH c AS (SELECT {_ROLE} AS role FROM pages),
    n AS (SELECT 'total_files' AS metric, CAST(count(*) AS VARCHAR) AS value FROM c UNION ALL SELECT 'files_' || role, CAST(count(*) AS VARCHAR) FROM c GROUP BY role),
    o AS (SELECT * FROM (VALUES ('total_files', 'old'), ('archives_found', '0')) v(metric, value))
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE metric NOT IN (SELECT metric FROM n)""")
def audit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.sql("SELECT * FROM VALUES ('total_files', 'old'), ('archives_found', '0') AS v(metric, value)")
    return audit.merge(audit.file_counts(_page_roles(spark, sf_dir)), old)


# ---------------------------------------------------------------- scores


_GROUP = "CASE WHEN l_partkey % 13 <> 0 THEN l_orderkey END"


def _members(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem as group members; one in thirteen has no group."""
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 13 != 0, F.col("l_orderkey")).alias("group_id"), "l_orderkey", "l_partkey", "l_linenumber", *columns)


@query(f"""SELECT group_id, l_orderkey, l_partkey, l_linenumber, l_extendedprice,
        CASE WHEN group_id IS NOT NULL THEN round(least(greatest(l_extendedprice / CASE WHEN m > 0 THEN m ELSE 1 END, 0), 1), 6) END AS price_n
    FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY group_id) AS m FROM (SELECT *, {_GROUP} AS group_id FROM lineitem))""")
def norm_max_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir, "l_extendedprice")
    return ranking.normalised(rows, "group_id", {"price_n": F.col("l_extendedprice")}).withColumn("price_n", F.round("price_n", 6))


@query(f"""SELECT group_id, l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN group_id IS NOT NULL THEN round(least(greatest((l_quantity - a) / CASE WHEN b <> a THEN b - a ELSE 1 END, 0), 1), 6) END AS quantity_n
    FROM (SELECT *, min(l_quantity) OVER w AS a, max(l_quantity) OVER w AS b FROM (SELECT *, {_GROUP} AS group_id FROM lineitem) WINDOW w AS (PARTITION BY group_id))""")
def minmax_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir, "l_quantity")
    return ranking.normalised(rows, "group_id", ranges={"quantity_n": F.col("l_quantity")}).withColumn("quantity_n", F.round("quantity_n", 6))


_SCENES = "WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS scene FROM orders)"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as files; one in eleven has no scene."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("scene"), "o_orderpriority", "o_orderstatus")


@query(_SCENES + """SELECT o.o_orderkey, o.scene, s.scene_group_size, s.scene_group_group_count, coalesce(s.scene_group_group_count > 1, false) AS scene_merge_candidate
    FROM o LEFT JOIN (SELECT scene, count(*) AS scene_group_size, count(DISTINCT o_orderpriority) AS scene_group_group_count FROM o WHERE scene IS NOT NULL GROUP BY 1) s ON s.scene = o.scene""")
def scene_size_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scene_sizes(_scenes(spark, sf_dir), "scene", "o_orderpriority").drop("o_orderpriority", "o_orderstatus")


@query(_SCENES + """, g AS (SELECT o_orderstatus AS status, o_custkey % 50 AS part, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS tags FROM o WHERE o_orderkey % 7 <> 0 GROUP BY 1, 2),
    c AS (SELECT scene, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS tags FROM o WHERE scene IS NOT NULL GROUP BY 1),
    t AS (SELECT o.*, CASE WHEN o_orderkey % 7 <> 0 THEN g.tags ELSE o_orderpriority END AS own FROM o LEFT JOIN g ON status = o_orderstatus AND part = o_custkey % 50)
    SELECT o_orderkey, own AS content_type_group, coalesce(c.tags, own) AS content_type_scene FROM t LEFT JOIN c USING (scene)""")
def tag_set_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of strict groups and scenes; rows without a group keep their own, rows without a scene their group's."""
    group = F.when(F.col("o_orderkey") % 7 != 0, F.concat("o_orderstatus", (F.col("o_custkey") % 50).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", group.alias("group_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("scene_group_id"), F.col("o_orderpriority").alias("content_type_file"))
    return ranking.content_tags(rows).select("o_orderkey", "content_type_group", "content_type_scene")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as photos with the raw metrics of the subject mode; one in thirteen parts has no group."""
    member = (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("asset_id")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_partkey") % 13 != 0, F.col("l_orderkey")).alias("group_id"), member).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    metrics = rows.select("group_id", "asset_id", F.col("l_quantity").alias("sharpness"), (F.col("l_extendedprice") * 3).alias("pixels"), F.col("l_tax").alias("subject_score"), F.col("l_discount").alias("aesthetic_score"), (F.col("l_discount") * 10).alias("composition_score"))
    return ranking.normalised(metrics, "group_id", scores.photo_shares(), scores.photo_ranges()).withColumn("final_score", F.round(scores.weighted(scores.PHOTO_SUBJECT), 6))


# the best of a group is chosen by: subject and aesthetics stretched over the group's range, sharpness and pixels as shares of its maximum
_SCORED = f"""
    WITH u AS (SELECT {_GROUP} AS group_id, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS asset_id, min(l_quantity) AS sharp, min(l_extendedprice) * 3 AS px, min(l_discount) AS aes, min(l_tax) AS subj FROM lineitem GROUP BY 1, 2),
    w AS (SELECT *, max(sharp) OVER g AS s1, max(px) OVER g AS p1, min(aes) OVER g AS a0, max(aes) OVER g AS a1, min(subj) OVER g AS b0, max(subj) OVER g AS b1 FROM u WINDOW g AS (PARTITION BY group_id)),
    s AS (SELECT group_id, asset_id, aes, round(0.24 * (aes * 10) + CASE WHEN group_id IS NULL THEN 0 ELSE 0.34 * (subj - b0) / CASE WHEN b1 <> b0 THEN b1 - b0 ELSE 1 END + 0.24 * (aes - a0) / CASE WHEN a1 <> a0 THEN a1 - a0 ELSE 1 END
                 + 0.14 * sharp / CASE WHEN s1 > 0 THEN s1 ELSE 1 END + 0.04 * px / CASE WHEN p1 > 0 THEN p1 ELSE 1 END END, 6) AS final_score FROM w)
"""


@query(_SCORED + """, b AS (SELECT group_id, arg_min(asset_id, (-final_score, asset_id)) AS best_asset_id, max(final_score) AS best_score FROM s WHERE group_id IS NOT NULL GROUP BY 1)
    SELECT s.group_id, asset_id, final_score, best_asset_id, best_score, coalesce(asset_id = best_asset_id, false) AS is_best FROM s LEFT JOIN b ON b.group_id = s.group_id""")
def photo_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ranking.mark_best(_scored(spark, sf_dir), "group_id", "final_score", "asset_id")
    return marked.select("group_id", "asset_id", "final_score", "best_asset_id", "best_score", "is_best")


@query(_SCORED + """, n AS (SELECT group_id, asset_id, final_score, CASE WHEN asset_id % 3 <> 0 THEN asset_id END AS a, CASE WHEN aes > 0.03 THEN aes END AS d FROM s WHERE group_id IS NOT NULL)
    SELECT group_id, arg_min(a, (-final_score, asset_id)) FILTER (a IS NOT NULL) AS first_asset, arg_min(d, (-final_score, asset_id)) FILTER (d IS NOT NULL) AS first_discount FROM n GROUP BY group_id""")
def best_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("group_id IS NOT NULL").withColumn("first_asset", F.when(F.col("asset_id") % 3 != 0, F.col("asset_id"))).withColumn("first_discount", F.when(F.col("aesthetic_score") > 0.03, F.col("aesthetic_score")))
    return ranking.first_non_null_best(rows, "group_id", "final_score", "asset_id", ["first_asset", "first_discount"])


@query("""WITH v AS (SELECT l_orderkey, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS asset_id, max(l_quantity) AS faces, max(l_discount) AS sym, max(l_tax) AS yaw FROM lineitem GROUP BY 1, 2),
    w AS (SELECT *, max(faces) OVER (PARTITION BY l_orderkey) AS m FROM v)
    SELECT l_orderkey, asset_id, round(0.08 * (1 - least(greatest(yaw, 0), 1)) + 0.08 * least(greatest(sym, 0), 1) + 0.03 * faces / CASE WHEN m > 0 THEN m ELSE 1 END, 10) AS final_score FROM w""")
def photo_face_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face mode with the optional metrics missing."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("asset_id")).agg(F.max("l_quantity").alias("faces"), F.max("l_discount").alias("face_symmetry"), F.max("l_tax").alias("head_yaw"))
    shares, plain = scores.face_terms(rows.columns)
    termed = ranking.normalised(rows, "l_orderkey", shares).withColumns(plain)
    for c in scores.PHOTO_FACE:
        if c not in termed.columns:
            termed = termed.withColumn(c, F.lit(0.0))
    return termed.select("l_orderkey", "asset_id", F.round(scores.weighted(scores.PHOTO_FACE), 10).alias("final_score"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measured videos, users as their groups; one in seventeen has no group, and columns lack values."""
    n = F.col("event_id")
    sound = F.when(n % 4 == 0, "true").when(n % 4 == 1, "0").when(n % 4 == 2, " True")
    return table(spark, sf_dir, "events").select(
        n.alias("asset_id"), F.when(n % 17 != 0, F.col("user_id")).alias("video_group_id"), F.concat(F.lit("v"), n.cast("string")).alias("file_name"), F.when(n % 9 != 0, F.col("value")).alias("duration_sec"), (24 + n % 7).cast("string").alias("fps"),
        F.when(n % 10 != 0, 640 * (1 + n % 3)).alias("width"), F.when(n % 10 != 0, 480 + n % 2 * 240).alias("height"), F.when(n % 8 != 0, F.lit(None)).otherwise("n/a").alias("bitrate_kbps"), (F.col("value") * 10 + n % 50).alias("bitrate_kbps_metric"), sound.alias("audio_present"),
        (n % 5).alias("sidecar_count"), F.when(n % 6 == 0, "failed").when(n % 6 != 1, "ok").alias("video_metrics_status"),
    )


def _measured_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live pairs of every third video, two for every sixth."""
    rows = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    gaps = F.filter(F.array((F.col("event_id") % 50 / 10).cast("double"), F.when(F.col("event_id") % 6 == 0, F.lit(0.7))), lambda g: g.isNotNull())
    return rows.select(F.col("event_id").alias("video_id"), F.posexplode(gaps).alias("photo_id", "time_gap")).withColumn("live_photo_status", F.when(F.col("time_gap") <= 1, "strong").otherwise("probable"))


_MEASURED = """
    WITH v AS (SELECT event_id AS asset_id, CASE WHEN event_id % 17 <> 0 THEN user_id END AS g, CASE WHEN event_id % 9 <> 0 THEN value ELSE 0 END AS dur, 24 + event_id % 7 AS fps,
            CASE WHEN event_id % 10 <> 0 THEN 640 * (1 + event_id % 3) * (480 + event_id % 2 * 240) ELSE 0 END AS px, value * 10 + event_id % 50 AS rate, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS audio, event_id % 5 AS sides,
            CASE WHEN event_id % 6 IN (0, 1) THEN 0 ELSE 1 END AS ok, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 6 = 0 THEN least(event_id % 50 / 10, 0.7) ELSE event_id % 50 / 10 END END AS gap FROM events),
    p AS (SELECT *, CASE WHEN gap <= 1 THEN 0.2 WHEN gap > 1 THEN 0.1 ELSE 0 END AS penalty, max(dur) OVER w AS m1, max(fps) OVER w AS m2, max(px) OVER w AS m3, max(rate) OVER w AS m4, max(sides) OVER w AS m5 FROM v WINDOW w AS (PARTITION BY g)),
    n AS (SELECT *, CASE WHEN g IS NULL THEN 0 ELSE 0.35 * least(greatest(px / CASE WHEN m3 > 0 THEN m3 ELSE 1 END, 0), 1) + 0.25 * least(greatest(rate / CASE WHEN m4 > 0 THEN m4 ELSE 1 END, 0), 1) + 0.12 * fps / m2
            + 0.08 * least(greatest(dur / CASE WHEN m1 > 0 THEN m1 ELSE 1 END, 0), 1) + 0.05 * sides / CASE WHEN m5 > 0 THEN m5 ELSE 1 END END + 0.10 * audio + 0.05 * ok AS raw FROM p),
    s AS (SELECT *, round_even(greatest(raw - penalty, 0), 6) AS score FROM n)
"""


def _four(score: str) -> Column:
    """A score of six places in four; no score is half-way between two, so that both engines round alike."""
    return F.round(F.col(score) + 0.0000005, 4).alias(score)


@query(_MEASURED + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, px DESC, rate DESC, dur DESC, fps DESC, asset_id) AS k FROM s WHERE g IS NOT NULL) WHERE k = 1)
    SELECT s.asset_id, s.g AS video_group_id, round(s.score + 0.0000005, 4) AS video_score, s.penalty AS live_photo_penalty, s.gap IS NOT NULL AS has_live_photo_pair, b.asset_id AS best_asset_id, 'v' || b.asset_id AS best_file, coalesce(s.asset_id = b.asset_id, false) AS is_best_video
    FROM s LEFT JOIN b ON b.g = s.g""")
def video_score_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight of the video score, the live-photo penalty and the marked best, from raw metrics."""
    out = video_plan.scored(_measured(spark, sf_dir), _measured_live(spark, sf_dir))
    return out.select("asset_id", "video_group_id", _four("video_score"), "live_photo_penalty", "has_live_photo_pair", "best_asset_id", "best_file", "is_best_video")


@query(_MEASURED + "SELECT g AS video_group_id, asset_id, round(score + 0.0000005, 4) AS video_score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, px DESC, rate DESC, dur DESC, fps DESC, asset_id) AS k FROM s WHERE g IS NOT NULL) WHERE k = 1")
def video_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best video of each group, as a row."""
    out = video_plan.scored(_measured(spark, sf_dir).where("video_group_id IS NOT NULL"), _measured_live(spark, sf_dir))
    return ranking.video_best(out).select("video_group_id", "asset_id", _four("video_score"))


@query(_MEASURED + """, r AS (SELECT g, count(*) AS size, bool_or(gap IS NOT NULL) AS has_live, bool_or(gap IS NULL) AS has_regular FROM s WHERE g IS NOT NULL GROUP BY 1)
    SELECT s.asset_id, s.g AS group_id, r.size AS scene_group_size, 'video' AS content_type_scene FROM s JOIN r ON r.g = s.g WHERE r.has_live AND r.size > 1""")
def video_review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review rows of video groups with a live photo."""
    rows = video_plan.review(video_plan.scored(_measured(spark, sf_dir).where("video_group_id IS NOT NULL"), _measured_live(spark, sf_dir)))
    shown = review.video_review_groups(rows, "group_id", regular=False, flag="has_live_photo_pair").select("group_id")
    return rows.join(shown, "group_id", "left_semi").select("asset_id", "group_id", "scene_group_size", "content_type_scene")


# ---------------------------------------------------------------- look-alikes

#: Thresholds for the surrogate photos, whose hashes lie far apart.
LIMITS = similarity.Limits(prefix=1, hash_distance=20, album_ahead=40, cross_ahead=20, near_seconds=120, near_steps=25, far_seconds=600, far_steps=80)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as photos: id, album, ts, seq, aspect, bits, phash, v."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> IF(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("album"), (F.col("vec_id") * 7 % 1000).cast("double").alias("ts"), F.col("vec_id").alias("seq"), (1 + F.col("vec_id") % 5 * 0.05).alias("aspect"), bits.alias("bits"), F.col("embedding").alias("v"))
    return rows.withColumn("phash", F.lpad(F.lower(F.hex("bits")), 16, "0"))


_PHOTOS = """
    WITH p AS (SELECT vec_id AS id, label AS album, CAST(vec_id * 7 % 1000 AS DOUBLE) AS ts, vec_id AS seq, 1 + vec_id % 5 * 0.05 AS aspect, embedding AS v FROM embeddings),
    o AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY ts, id) AS an, row_number() OVER (ORDER BY ts, id) AS gn FROM p)
"""
_D = "CAST(len(list_filter(list_zip(a.v, b.v), lambda z: (z[1] > 0) <> (z[2] > 0))) AS INTEGER)"
_BLOCKED = f"""SELECT a.id AS img1, b.id AS img2, {_D} AS distance FROM p a JOIN p b ON a.id < b.id AND (a.v[64] > 0) = (b.v[64] > 0) AND (a.v[63] > 0) = (b.v[63] > 0) AND (a.v[62] > 0) = (b.v[62] > 0) AND (a.v[61] > 0) = (b.v[61] > 0)"""


@query(_PHOTOS + f"SELECT img1, img2, distance, 1 - distance / 64.0 AS similarity, 'phash' AS match_source, 'strict' AS pair_scope FROM ({_BLOCKED}) WHERE distance <= 20")
def phash_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.blocked_pairs(photos(spark, sf_dir), LIMITS, "id")


def _in_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.positions(photos(spark, sf_dir).drop("phash"), [F.col("album"), F.col("ts"), F.col("id")])


@query(_PHOTOS + f"""SELECT img1, img2, distance, 1 - distance / 64.0 AS similarity, 'phash_local' AS match_source, 'strict' AS pair_scope FROM (
    SELECT a.id AS img1, b.id AS img2, {_D} AS distance FROM o a JOIN o b ON a.album = b.album AND b.an BETWEEN a.an + 1 AND a.an + 40 WHERE b.ts - a.ts <= 120 OR abs(a.seq - b.seq) <= 25) WHERE distance <= 20""")
def lookahead_pairs_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.local_pairs(_in_album(spark, sf_dir), LIMITS)


@query(_PHOTOS + f""", c AS (SELECT a.id AS img1, b.id AS img2, {_D} AS distance, b.ts - a.ts AS dt, abs(a.seq - b.seq) AS ds, abs(a.aspect - b.aspect) AS da FROM o a JOIN o b ON a.album = b.album AND b.an BETWEEN a.an + 1 AND a.an + 40),
    t AS (SELECT *, dt <= 120 AND ds <= 25 AS near, dt <= 5 AND ds <= 15 AND distance <= 18 AS burst FROM c WHERE dt <= 600 OR ds <= 80)
    SELECT img1, img2, distance, CASE WHEN burst THEN 0.95 WHEN near THEN 0.94 ELSE 0.965 END AS clip, CASE WHEN burst THEN 0.90 WHEN near THEN 0.88 END AS background
    FROM t WHERE da <= CASE WHEN near THEN 0.75 ELSE 0.12 END AND distance > 20 AND distance <= CASE WHEN near THEN 40 ELSE 24 END""")
def album_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.album_candidates(_in_album(spark, sf_dir), LIMITS)


@query(_PHOTOS + f"""SELECT img1, img2, distance, 0.90 AS clip, 0.86 AS background FROM (
    SELECT a.id AS img1, b.id AS img2, {_D} AS distance FROM o a JOIN o b ON b.gn BETWEEN a.gn + 1 AND a.gn + 20 WHERE a.album <> b.album AND b.ts - a.ts <= 90 AND abs(a.seq - b.seq) <= 500 AND abs(a.aspect - b.aspect) <= 0.12) WHERE distance > 10 AND distance <= 18""")
def lookahead_pairs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.positions(photos(spark, sf_dir).drop("phash"), [F.col("ts"), F.col("id")])
    return similarity.cross_candidates(rows, similarity.Limits(hash_distance=10, cross_steps=500))


def _blocked_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked pairs with the dots of their vectors (sim) and views (dot1, ...)."""
    rows = _with_views(photos(spark, sf_dir))
    return similarity.blocked_dots(rows, {"v": "sim"} | {f"view{at}": f"dot{at}" for at in VIEW_STARTS}, LIMITS, "id")


#: Where the slices of a vector that stand for crop views begin.
VIEW_STARTS = (1, 22, 43)


def _with_views(rows: DataFrame) -> DataFrame:
    """Photos with three slices of their vector, each scaled to length one, once a photo."""
    return rows.select("id", "phash", "v", *[similarity.unit(F.slice("v", at, 22)).alias(f"view{at}") for at in VIEW_STARTS])


def _background() -> Column:
    return similarity.top_two_mean(*[F.col(f"dot{at}") for at in VIEW_STARTS])


def _cos_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _view_sql(at: int) -> str:
    x, y = f"a.v[{at}:{at + 21}]", f"b.v[{at}:{at + 21}]"
    return f"{_cos_sql(x, y)} / sqrt({_cos_sql(x, x)}) / sqrt({_cos_sql(y, y)})"


_VECTORS = _PHOTOS + f""", q AS (SELECT img1, img2, distance, {_cos_sql('a.v', 'b.v')} AS sim, {_view_sql(1)} AS v1, {_view_sql(22)} AS v2, {_view_sql(43)} AS v3
    FROM ({_BLOCKED}) k JOIN p a ON a.id = img1 JOIN p b ON b.id = img2 WHERE distance <= 20)"""


@query(_VECTORS + "SELECT img1, img2, round(sim, 5) AS similarity FROM q")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked_dots(spark, sf_dir).select("img1", "img2", F.round("sim", 5).alias("similarity"))


@query(_VECTORS + "SELECT img1, img2, round((v1 + v2 + v3 - least(v1, v2, v3)) / 2, 5) AS background FROM q")
def background_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.blocked_views(photos(spark, sf_dir), "v", VIEW_STARTS, 22, LIMITS, "id")
    return pairs.select("img1", "img2", F.round("background", 5).alias("background"))


@query(_VECTORS + """, s AS (SELECT *, (v1 + v2 + v3 - least(v1, v2, v3)) / 2 AS bg, CASE WHEN img1 % 2 = 0 AND img2 % 2 = 0 THEN v1 END AS face FROM q),
    t AS (SELECT *, (sim + 0.55 >= 0.90 OR (bg + 0.4 >= 0.93 AND distance <= 12 AND sim + 0.55 >= 0.90) OR (bg + 0.4 >= 0.90 AND distance <= 28 AND sim + 0.55 >= 0.91))
             AND NOT (bg + 0.4 >= 0.90 AND sim + 0.55 <= 0.975 AND distance <= 22 AND coalesce(face + 0.4 < 0.88, false)) AS scene FROM s)
    SELECT img1, img2, distance, round(sim + 0.55, 5) AS similarity, pair_scope FROM (
        SELECT *, 'scene' AS pair_scope FROM t WHERE scene UNION ALL SELECT *, 'strict' FROM t WHERE scene AND bg + 0.4 >= 0.86)""")
def pair_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities are raised by constants so that the surrogate pairs meet every rule."""
    face = F.when((F.col("img1") % 2 == 0) & (F.col("img2") % 2 == 0), F.col("dot1") + 0.4)
    pairs = _blocked_dots(spark, sf_dir).select("img1", "img2", "distance", (F.col("sim") + 0.55).alias("sim"), (_background() + 0.4).alias("bg"), face.alias("face"))
    judged = stored(pairs, "similarities").withColumn("clip", F.lit(0.90)).withColumn("background", F.lit(0.86))
    found = similarity.decisions(judged, F.col("sim"), F.col("bg"), F.col("face"))
    return found.select("img1", "img2", "distance", F.round("similarity", 5).alias("similarity"), "pair_scope")


#: Copies of a surrogate photo: bits flipped in the hash, seconds and numbers after the first, change of shape.
BURST = ((0, 0, 0, 0.0), (3, 2, 1, 0.0), (5, 4, 3, 0.0625), (6, 5, 15, 0.0), (16, 9, 16, 0.0), (18, 14, 20, 0.75), (24, 119, 26, 0.125), (25, 130, 40, 0.0), (40, 140, 60, 0.25), (9, 14400, 700, 0.0))


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as photos with near copies that straddle the production thresholds; hashes differ in the low bits."""
    copies = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((1 << n) - 1).cast("long").alias("mask"), F.lit(t).cast("double").alias("t"), F.lit(q).cast("long").alias("q"), F.lit(a).cast("double").alias("a")) for k, (n, t, q, a) in enumerate(BURST)])
    rows = photos(spark, sf_dir).select(F.col("id").alias("base"), "bits", "v", F.explode(copies).alias("c")).select("base", "bits", "v", "c.*")
    other = F.when(F.col("k") % 4 == 3, 1).otherwise(0)  # some copies lie in another album
    placed = rows.select((F.col("base") * 100 + F.col("k")).alias("id"), (F.col("base") % 20 * 2 + other).alias("album"), (F.col("base") * 1000.0 + F.col("t")).alias("ts"), F.when((F.col("base") + F.col("k")) % 13 != 0, F.col("base") * 200 + F.col("q")).alias("seq"), F.when(F.col("base") % 7 != 0, 1 + F.col("a")).alias("aspect"), F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"))
    return placed.withColumn("phash", F.lpad(F.lower(F.hex("bits")), 16, "0"))


_BURST_ROWS = ", ".join(f"({k}, {n}, {t}, {q}, {a})" for k, (n, t, q, a) in enumerate(BURST))
_BURSTS = f"""
    WITH c AS (SELECT * FROM (VALUES {_BURST_ROWS}) AS t(k, n, t, q, a)),
    p AS (SELECT vec_id * 100 + k AS id, vec_id % 20 * 2 + CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS album, vec_id * 1000.0 + t AS ts, CASE WHEN (vec_id + k) % 13 <> 0 THEN vec_id * 200 + q END AS seq, CASE WHEN vec_id % 7 <> 0 THEN 1 + CAST(a AS DOUBLE) END AS aspect,
              list_transform(embedding, lambda x, i: (x > 0) <> (i <= n)) AS v FROM embeddings, c),
    o AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY ts, id) AS an, row_number() OVER (ORDER BY ts, id) AS gn FROM p)
"""
_BD = "CAST(len(list_filter(list_zip(a.v, b.v), lambda z: z[1] <> z[2])) AS INTEGER)"
_HEAD = " AND ".join(f"a.v[{k}] = b.v[{k}]" for k in range(64, 48, -1))


def _burst_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.positions(bursts(spark, sf_dir).drop("phash"), [F.col("album"), F.col("ts"), F.col("id")])


@query(_BURSTS + f"SELECT img1, img2, distance, pair_scope FROM (SELECT a.id AS img1, b.id AS img2, {_BD} AS distance, 'strict' AS pair_scope FROM p a JOIN p b ON a.id < b.id AND {_HEAD}) WHERE distance <= 5")
def phash_pairs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production prefix and distance: 16 bits and 5."""
    return similarity.blocked_pairs(bursts(spark, sf_dir), id_col="id").select("img1", "img2", "distance", "pair_scope")


@query(_BURSTS + f"""SELECT img1, img2, distance FROM (SELECT a.id AS img1, b.id AS img2, {_BD} AS distance FROM o a JOIN o b ON a.album = b.album AND b.an BETWEEN a.an + 1 AND a.an + 40
    WHERE b.ts - a.ts <= 120 OR coalesce(abs(a.seq - b.seq) <= 25, false)) WHERE distance <= 5""")
def local_pairs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production limits of the neighbourhood hash join."""
    return similarity.local_pairs(_burst_order(spark, sf_dir)).select("img1", "img2", "distance")


@query(_BURSTS + f""", e AS (SELECT a.id AS img1, b.id AS img2, {_BD} AS distance, b.ts - a.ts AS dt, coalesce(abs(a.seq - b.seq), 1e9) AS ds, abs(a.aspect - b.aspect) AS da FROM o a JOIN o b ON a.album = b.album AND b.an BETWEEN a.an + 1 AND a.an + 40),
    t AS (SELECT *, dt <= 120 AND ds <= 25 AS near FROM e WHERE dt <= 14400 OR ds <= 80),
    x AS (SELECT *, CASE WHEN near THEN 0.94 ELSE 0.965 END AS c0, CASE WHEN near THEN 40 ELSE 24 END AS d0, CASE WHEN near THEN 0.75 ELSE 0.12 END AS a0, CASE WHEN near THEN 0.88 END AS b0, dt <= 5 AND ds <= 15 AND distance <= 18 AS burst FROM t)
    SELECT img1, img2, distance, CASE WHEN burst THEN 0.95 ELSE c0 END AS clip, CASE WHEN burst THEN 0.90 ELSE b0 END AS background FROM x WHERE coalesce(da <= a0, true) AND distance > 5 AND distance <= CASE WHEN burst THEN greatest(d0, 18) ELSE d0 END""")
def album_candidates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production thresholds of album candidates: default, near and burst."""
    return similarity.album_candidates(_burst_order(spark, sf_dir))


@query(_BURSTS + f"""SELECT img1, img2, distance, 0.90 AS clip, 0.86 AS background FROM (SELECT a.id AS img1, b.id AS img2, {_BD} AS distance FROM o a JOIN o b ON b.gn BETWEEN a.gn + 1 AND a.gn + 20
    WHERE a.album <> b.album AND b.ts - a.ts <= 90 AND abs(a.seq - b.seq) <= 10 AND coalesce(abs(a.aspect - b.aspect) <= 0.12, true)) WHERE distance > 5 AND distance <= 18""")
def cross_candidates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production thresholds of candidates across albums."""
    rows = order.positions(bursts(spark, sf_dir).drop("phash"), [F.col("ts"), F.col("id")])
    return similarity.cross_candidates(rows)


def _components_sql(edges: str) -> str:
    return f""", e AS ({edges}), both_ways AS (SELECT img1 AS s, img2 AS t FROM e UNION SELECT img2, img1 FROM e),
    reach AS (SELECT s AS node, s AS label FROM both_ways UNION SELECT t, label FROM reach JOIN both_ways ON node = s),
    least_of AS (SELECT node, min(label) AS root FROM reach GROUP BY node)
    SELECT node AS file_id, root, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS group_id FROM least_of"""


def _components(edges: DataFrame) -> DataFrame:
    found = graph.connected_components(edges, "img1", "img2", whole=True)
    return graph.group_ids(found).select(F.col("node").alias("file_id"), F.col("component").alias("root"), "group_id")


@query((_PHOTOS + _components_sql(f"SELECT img1, img2 FROM ({_BLOCKED}) WHERE distance <= 20")).replace("WITH p", "WITH RECURSIVE p", 1))
def components_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(similarity.class_links(photos(spark, sf_dir), LIMITS, "id"))


@query((_PHOTOS + _components_sql(f"SELECT img1, img2 FROM ({_BLOCKED}) WHERE distance <= 20 UNION SELECT a.id, b.id FROM o a JOIN o b ON a.album = b.album AND b.an BETWEEN a.an + 1 AND a.an + 40 WHERE (b.ts - a.ts <= 120 OR abs(a.seq - b.seq) <= 25) AND {_D} <= 20")).replace("WITH p", "WITH RECURSIVE p", 1))
def components_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = stored(similarity.class_pairs(photos(spark, sf_dir), LIMITS, "id"), "strict-pairs")
    local = similarity.local_pairs(_in_album(spark, sf_dir), LIMITS)
    return _components(strict.union(similarity.without_edges(local, strict).select(strict.columns)))


# ---------------------------------------------------------------- videos


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as videos that straddle the production thresholds: fifty an album, seconds apart, times of both sources and none."""
    n = F.col("event_id")
    source = F.when(n % 53 == 0, "missing").when((n % 7).isin(0, 1, 2), "fs").otherwise("json")
    ts = F.when(n % 53 != 0, (n % 50 * 23 + n * 7919 % 101).cast("double"))
    rows = table(spark, sf_dir, "events").select(n.alias("id"), F.floor(n / 50).alias("album"), ts.alias("ts"), (n * 3 % 41).alias("num"), source.alias("source"), F.when(n % 6 != 0, 16).alias("width"), (n % 3 + 1).alias("height"), F.when(n % 5 != 0, F.concat(F.lit(" "), F.upper("event_type"))).otherwise(F.col("event_type")).alias("codec"), F.col("value").alias("duration"))
    return order.positions(rows, [F.col("album"), F.col("ts").asc_nulls_last(), F.col("num"), F.col("id")])


_VIDEOS = """
    WITH RECURSIVE v AS (SELECT event_id AS id, event_id // 50 AS album, CASE WHEN event_id % 53 <> 0 THEN event_id % 50 * 23 + event_id * 7919 % 101 END AS ts, event_id * 3 % 41 AS num, event_id % 53 <> 0 AND event_id % 7 < 3 AS fs, event_id % 6 <> 0 AS wide, event_id % 3 AS h, event_type AS codec, value AS duration FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY ts NULLS LAST, num, id) AS rn FROM v),
    p AS (SELECT a.id AS src, b.id AS dst, abs(a.ts - b.ts) AS dt, abs(a.num - b.num) AS dn, a.fs AND b.fs AS fs_only, a.wide AND b.wide AND a.h = b.h AS size, a.codec = b.codec AS codec,
                 CASE WHEN a.duration > 0 AND b.duration > 0 THEN greatest(a.duration, b.duration) / least(a.duration, b.duration) END AS ratio
          FROM n a JOIN n b ON a.album = b.album AND b.rn BETWEEN a.rn + 1 AND a.rn + 8 WHERE a.ts IS NOT NULL AND b.ts IS NOT NULL),
    links AS (SELECT * FROM (SELECT src, dst, CASE WHEN dt <= 30 THEN 'close_time' WHEN NOT fs_only AND dn <= 20 AND dt <= 120 THEN 'number_time' WHEN NOT fs_only AND dn <= 6 AND dt <= 300 AND (size OR codec) THEN 'number_format'
              WHEN fs_only AND dn <= 6 AND dt <= 45 AND size THEN 'file_time' WHEN ratio <= 1.35 AND dt <= 20 AND size THEN 'duration' END AS reason FROM p) WHERE reason IS NOT NULL)
"""


@query(_VIDEOS + "SELECT src, dst, reason FROM links")
def video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.video_links(videos(spark, sf_dir))


@query(_VIDEOS + """, both_ways AS (SELECT src AS s, dst AS t FROM links UNION SELECT dst, src FROM links),
    reach AS (SELECT s AS node, s AS label FROM both_ways UNION SELECT t, label FROM reach JOIN both_ways ON node = s),
    least_of AS (SELECT node, min(label) AS root FROM reach GROUP BY node)
    SELECT id, coalesce(root, id) AS video_group_id, count(*) OVER (PARTITION BY coalesce(root, id)) AS video_group_size FROM v LEFT JOIN least_of ON node = id""")
def video_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = videos(spark, sf_dir)
    groups = stored(video.video_groups(rows, video.video_links(rows)), "video-groups")
    return ranking.group_sizes(groups, "video_group_id", "id", "video_group_size").select("id", "video_group_id", "video_group_size")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as videos and clicks as photos of hundred albums, seconds apart; a third of the stems is null."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n.alias("id"), (n % 100).alias("album"), F.when(n % 3 != 0, n % 2).alias("stem"), (F.floor(n / 100) * 2.5 + n % 7 * 0.5).alias("ts"), (F.col("value") / 10).alias("duration"), "event_type")
    return video.live_pairs(rows.where("event_type = 'view'"), rows.where("event_type = 'click'").drop("duration"))


_LIVE = """
    WITH r AS (SELECT event_id, event_id % 100 AS album, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 END AS stem, event_id // 100 * 2.5 + event_id % 7 * 0.5 AS t, value / 10 AS duration, event_type FROM events),
    l AS (SELECT v.event_id AS video_id, p.event_id AS photo_id, abs(v.t - p.t) AS gap FROM r v JOIN r p ON v.album = p.album AND v.stem IS NOT DISTINCT FROM p.stem
          WHERE v.event_type = 'view' AND p.event_type = 'click' AND v.duration <= 4 AND abs(v.t - p.t) <= 5)
"""


@query(_LIVE + "SELECT video_id, photo_id, round(gap, 5) AS time_gap, CASE WHEN gap <= 1 THEN 'strong' ELSE 'probable' END AS live_photo_status FROM l")
def live_photo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).withColumn("time_gap", F.round("time_gap", 5))


@query(_LIVE + "SELECT video_id, photo_id, round(gap, 5) AS time_gap FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY gap, photo_id) AS rn FROM l) WHERE rn = 1")
def live_photo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.nearest_live(_live(spark, sf_dir)).select("video_id", "photo_id", F.round("time_gap", 5).alias("time_gap"))


# ---------------------------------------------------------------- scalar functions


@query(r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\d+)\D*$', 1), '') AS BIGINT) AS last_number, TRY_CAST(nullif(regexp_extract(url, '(\d{3,})', 1), '') AS BIGINT) AS numeric_token,
    lower(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '([^.])\.[^.]*$', '\1')) AS stem FROM pages""")
def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.last_number(url).alias("last_number"), names.numeric_token(url).alias("numeric_token"), names.normal_stem(names.file_name(url)).alias("stem"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST(event_id - 50 AS DOUBLE) WHEN event_id % 4 = 0 THEN event_id + 0.5 ELSE 0.0 END AS capture_ts,
    CASE WHEN event_id % 3 = 1 AND event_id > 50 THEN 'json' WHEN event_id % 4 = 0 THEN 'fs' ELSE 'missing' END AS time_source, CASE WHEN event_id % 3 = 1 AND event_id > 50 THEN CAST(event_id - 50 AS DOUBLE) WHEN event_id % 4 = 0 THEN event_id + 0.5 END AS chosen_ts,
    CASE WHEN event_id % 3 = 1 THEN CAST(event_id - 50 AS DOUBLE) WHEN event_id % 4 = 0 THEN event_id + 0.5 END AS first_ts FROM events""")
def capture_ts_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three orders of precedence; one needs positive seconds and tells its source."""
    exif = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", coerce.EXIF_FORMAT)).otherwise("not a date")
    json = F.when(F.col("event_id") % 3 == 1, (F.col("event_id") - 50).cast("string")).otherwise("nan")
    fs = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") + 0.5).cast("string")).otherwise("")
    chosen, source = coerce.chosen_time(json, fs)
    return table(spark, sf_dir, "events").select("event_id", coerce.capture_seconds(exif, json, fs).alias("capture_ts"), source.alias("time_source"), chosen.alias("chosen_ts"), coerce.first_time(json, fs).alias("first_ts"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 4 = 1 THEN CAST(user_id AS VARCHAR) END AS json_datetime FROM events""")
def json_sidecar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.struct(F.col(c).cast("string").alias("timestamp"))
    doc = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(stamp("event_id").alias("photoTakenTime"), stamp("user_id").alias("creationTime")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(stamp("user_id").alias("creationTime")))).when(F.col("event_id") % 4 == 2, "{broken").otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", coerce.json_datetime(doc).alias("json_datetime"))


@query("""SELECT p_partkey, CASE WHEN w IS NULL THEN NULL WHEN (png OR (w > 0 AND h > 0 AND h / w >= 1.8)) AND face < 0.005 THEN 'document' WHEN face >= 0.03 THEN 'people' WHEN png AND shot AND face < 0.01 THEN 'document' ELSE 'landscape' END AS content_type
    FROM (SELECT p_partkey, p_size % 3 = 0 AS png, p_partkey % 4 < 2 AS shot, CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 11 * 2 END AS w, CAST(p_size AS DOUBLE) AS h, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey % 50 / 1000.0 END AS face FROM part)""")
def content_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 50 / 1000.0)
    name = F.element_at(F.array(*[F.lit(x) for x in ("/a/My Screenshot", "/IMG_", "/screens/x", "/b")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(name, F.when(F.col("p_size") % 3 == 0, ".PNG").otherwise(".jpg"))
    return table(spark, sf_dir, "part").select("p_partkey", names.content_type(path, F.when(F.col("p_partkey") % 19 != 0, F.col("p_partkey") % 11 * 2), F.col("p_size"), face).alias("content_type"))


@query("""SELECT page_id, CASE WHEN contains(path, '.') THEN 'media/photo' ELSE 'other' END AS file_role, path AS file_name, sha1(lower(url)) AS asset_id FROM (
    SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.JPG' WHEN 1 THEN '/b' WHEN 2 THEN '/c' WHEN 3 THEN '/.hidden' ELSE '/d.png' END AS url, CASE page_id % 5 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN '.hidden' ELSE 'd.png' END AS full_name,
           CASE page_id % 5 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'hidden' ELSE 'd.png' END AS path FROM pages)""".replace("path AS file_name", "full_name AS file_name"))
def raw_file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in ("/a.JPG", "/b", "/c", "/.hidden", "/d.png")]), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", names.file_role(url).alias("file_role"), names.file_name(url).alias("file_name"), names.asset_id(url).alias("asset_id"))


# ---------------------------------------------------------------- cleanup, plans, review


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an index for a cleanup: hashes, perceptual hashes and groups are missing here and there, some rows are videos."""
    n = F.col("asset_id")
    rows = assets(spark, sf_dir)
    kind = F.when(n % 9 == 0, ".MOV").otherwise(".Txt")
    return rows.select(
        "asset_id", F.concat(F.lit(" /in/"), "content_type", kind).alias("file_path"), (F.col("file_size") % 3).alias("file_size"), F.when(n % 4 != 0, F.upper("sha256")).when(n % 8 == 0, " nan ").alias("sha256"), F.when(n % 8 == 0, F.substring("sha256", 1, 2)).alias("phash"),
        F.when(n % 16 != 0, "10").alias("width"), F.lit("20.0").alias("height"), F.when(F.col("has_sidecar"), "x.json").when(n % 3 == 0, "None").alias("json_path"), F.when(n % 5 != 0, (n % 100).cast("string")).otherwise("?").alias("score"),
        F.when(n % 6 == 0, " NaN").when(n % 2 == 0, (n % 30).cast("string")).alias("group_id"),
    )


_INDEX = """
    WITH a AS (SELECT doc_id AS asset_id, lower(source) || CASE WHEN doc_id % 9 = 0 THEN '.mov' ELSE '.txt' END AS name, CASE WHEN doc_id % 9 = 0 THEN '.mov' ELSE '.txt' END AS ext, doc_id % 9 = 0 AS video, n_chars % 3 AS size, CASE WHEN doc_id % 4 <> 0 THEN sha256(text) END AS sha,
            CASE WHEN doc_id % 8 = 0 THEN left(sha256(text), 2) END AS phash, doc_id % 16 <> 0 AS wide, doc_id IN (SELECT doc_id FROM labels) AS has_json, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100 END AS rating, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN doc_id % 30 END AS grp, CASE WHEN doc_id % 6 = 0 THEN ' NaN' WHEN doc_id % 2 = 0 THEN CAST(doc_id % 30 AS VARCHAR) ELSE 'nan' END AS grp_text FROM documents),
    k AS (SELECT *, CASE WHEN sha IS NOT NULL THEN sha WHEN phash IS NOT NULL AND wide THEN 'strict::' || phash || '::' || size || '::10x20::' || ext ELSE 'fallback::' || name || '::' || size END AS duplicate_key FROM a),
    m AS (SELECT 'auto' AS mode, *, CASE WHEN grp IS NOT NULL THEN 'group_id::' || grp ELSE duplicate_key END || '||' || duplicate_key AS safe_subgroup FROM k WHERE NOT video
          UNION ALL SELECT 'exact', *, duplicate_key || '||' || duplicate_key FROM k WHERE NOT video UNION ALL SELECT 'group_id', *, 'group_id::' || grp_text || '||' || duplicate_key FROM k)
"""


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir)
    rating = cleanup.rating_column(rows.columns)
    modes = [cleanup.working_frame(rows, rating, m, videos=m == "group_id").select(F.lit(m).alias("mode"), "asset_id", "duplicate_key", F.concat(F.lit(m), "safe_subgroup").alias("own"), "safe_subgroup", "sha", "has_json", "rating_value") for m in cleanup.GROUP_MODES]
    return modes[0].union(modes[1]).union(modes[2])


@query(_INDEX + "SELECT mode, asset_id, duplicate_key, safe_subgroup, has_json, CAST(rating AS DOUBLE) AS rating_value FROM m")
def cleanup_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working frame in its three group modes; one of them with videos."""
    return _modes(spark, sf_dir).select("mode", "asset_id", "duplicate_key", "safe_subgroup", "has_json", "rating_value")


@query(_INDEX + """, f AS (SELECT *, count(*) OVER g AS n, bool_or(has_json) OVER g AS y, bool_or(NOT has_json) OVER g AS x, count(sha) OVER g = count(*) OVER g AND min(sha) OVER g = max(sha) OVER g AS exact, max(CASE WHEN has_json THEN rating END) OVER g AS best
        FROM m WINDOW g AS (PARTITION BY mode, safe_subgroup))
    SELECT mode, asset_id, safe_subgroup, reason FROM (SELECT *, CASE WHEN exact THEN 'exact_copy_without_json' WHEN rating < best THEN 'lower_rated' END AS reason FROM f WHERE n >= 2 AND y AND x AND NOT has_json) WHERE reason IS NOT NULL""")
def cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may go in each mode, by rating."""
    return cleanup.delete_candidates(_modes(spark, sf_dir), "own", "rating_value").select("mode", "asset_id", "safe_subgroup", "reason")


@query(_INDEX + """, f AS (SELECT *, bool_or(has_json) OVER g AS y, count(sha) OVER g = count(*) OVER g AND min(sha) OVER g = max(sha) OVER g AS exact FROM m WINDOW g AS (PARTITION BY mode, safe_subgroup))
    SELECT mode, asset_id FROM f WHERE y AND NOT has_json AND exact""")
def cleanup_without_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a rating only exact copies may go."""
    return cleanup.delete_candidates(_modes(spark, sf_dir).withColumn("rating_value", F.lit(None).cast("double")), "own", "rating_value").select("mode", "asset_id")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = dedupe.fold_copies(assets(spark, sf_dir))
    rows = folded.select("asset_id", F.col("asset_id").alias("group_id"), F.concat(F.lit("/in/"), F.col("asset_id").cast("string"), F.lit(".txt")).alias("path"), F.col("content_type").alias("album"), "sidecars", F.lit(1.0).alias("best_score"))
    return curation.curation_plan(rows, "/library")


_PLAN = _ASSETS + """,
    s AS (SELECT sha256, list(asset_id || '.json' ORDER BY asset_id) FILTER (has_sidecar) AS sides FROM a GROUP BY sha256),
    m AS (SELECT sha256, source, row_number() OVER (PARTITION BY sha256 ORDER BY count(*) DESC, min(asset_id)) AS k FROM a GROUP BY sha256, source),
    plan AS (SELECT r.asset_id, m.source AS album, coalesce(s.sides, []) AS sides FROM r JOIN s USING (sha256) JOIN m ON m.sha256 = r.sha256 AND m.k = 1 WHERE r.rn = 1)
"""


@query(_PLAN + "SELECT asset_id, 'best_in_group' AS selection_reason, '/in/' || asset_id || '.txt' AS primary_source_path, '/library/' || album || '/' || asset_id || '.txt' AS primary_target_path, CAST(len(sides) AS INTEGER) AS sidecar_count FROM plan")
def curation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("asset_id", "selection_reason", "primary_source_path", "primary_target_path", "sidecar_count")


@query(_PLAN + """SELECT asset_id, 0 AS entry, 'primary' AS entry_kind, '/in/' || asset_id || '.txt' AS source_path, '/library/' || album || '/' || asset_id || '.txt' AS target_path FROM plan
    UNION ALL SELECT asset_id, CAST(i AS INTEGER), 'sidecar', sides[i], '/library/' || album || '/' || sides[i] FROM (SELECT *, unnest(generate_series(1, len(sides))) AS i FROM plan)""")
def manifest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.manifest(_plan(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as review rows: comma-joined tags, customers as scenes, one in eleven without."""
    first = F.left("o_orderpriority", F.lit(1))
    own = F.when(first == "1", " People").when(first == "2", "landscape,other").when(first == "3", "Document , landscapes").when(first == "4", "").otherwise(F.lit(None))
    more = F.when(F.col("o_orderkey") % 5 == 0, "people, video")
    scene = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(scene.alias("scene_group_id"), (F.col("o_orderkey") % 40 + 1_000_000).alias("group_id"), own.alias("content_type_file"), more.alias("content_type_scene"))


_TAGGED = """
    WITH o AS (SELECT coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END, o_orderkey % 40 + 1000000) AS display_id, o_orderkey % 40 + 1000000 AS group_id,
            list_concat(CASE left(o_orderpriority, 1) WHEN '1' THEN ['people'] WHEN '2' THEN ['landscapes'] WHEN '3' THEN ['documents', 'landscapes'] ELSE [] END, CASE WHEN o_orderkey % 5 = 0 THEN ['people', 'video'] ELSE [] END) AS tags FROM orders),
    t AS (SELECT display_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS categories, bool_or(tag IN ('people', 'documents')) AS shown FROM (SELECT display_id, unnest(tags) AS tag FROM o) GROUP BY 1),
    g AS (SELECT display_id, count(*) AS size, string_agg(DISTINCT group_id, ', ' ORDER BY group_id) AS strict FROM o GROUP BY 1)
"""


@query(_TAGGED + "SELECT display_id, size, categories, CAST(display_id AS VARCHAR) AS common_label, CASE WHEN strict = CAST(display_id AS VARCHAR) THEN '' ELSE strict END AS private_label FROM g JOIN t USING (display_id) WHERE shown")
def review_groups_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.photo_groups(_tagged(spark, sf_dir), ["people", "documents"])
    return found.withColumn("categories", F.array_join("categories", "|")).drop("label")


@query("SELECT user_id, count(*) AS size, bool_or(event_type = 'view') AS has_live, bool_or(event_type <> 'view') AS has_regular FROM events GROUP BY user_id HAVING count(*) > 1 AND bool_or(event_type = 'view')")
def review_video_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most videos have a null flag, as a left join leaves them."""
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", False).alias("is_live"))
    return review.video_review_groups(rows, "user_id", live=True, regular=False)


@query("""SELECT o_custkey, unnest(list_concat(list_filter([CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END, CASE WHEN count(DISTINCT coalesce(p, 'none')) > 1 THEN 'p' END, CASE WHEN count(DISTINCT o_orderdate) > 1 THEN 'o_orderdate' END], lambda c: c IS NOT NULL), ['size_wh'])) AS metric
    FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p FROM orders) GROUP BY o_custkey""")
def review_varying_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height differ, but give way to the size; a null is a text of its own."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"), "o_orderdate", F.col("o_orderkey").alias("width"), F.lit(5).alias("height"))
    return review.varying_columns(rows, "o_custkey", ["o_orderstatus", "p", "o_orderdate", "width", "height"])


# ---------------------------------------------------------------- more filters, joins and functions


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size / 1001.0 WHEN p_size % 4 = 2 THEN CAST(p_size AS DOUBLE) END AS fps,
    CASE p_size % 3 WHEN 0 THEN 'H264' WHEN 1 THEN 'avc1' END AS codec FROM part""")
def ratio_and_fourcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit("/0"))).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit("/1001"))).when(F.col("p_size") % 4 == 2, size).otherwise("n/a")
    code = F.when(F.col("p_size") % 3 == 0, 0x34363248).when(F.col("p_size") % 3 == 1, 0x31637661).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", coerce.ratio(text).alias("fps"), coerce.fourcc(code).alias("codec"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag, CASE p_size % 4 WHEN 0 THEN p_name || '|x' WHEN 1 THEN '' WHEN 2 THEN p_name ELSE '' END AS sidecars FROM part""")
def truth_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "0", "TRUE", "maybe", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    text = F.when(F.col("p_size") % 4 == 0, F.to_json(F.array("p_name", F.lit("x")))).when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise("0")
    return table(spark, sf_dir, "part").select("p_partkey", coerce.truth(word, False).alias("flag"), F.array_join(coerce.sidecar_list(text), "|").alias("sidecars"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'landscapes' WHEN 1 THEN 'people' WHEN 2 THEN 'documents' END AS label, p_size / nullif(CAST(p_size % 3 AS DOUBLE), 0) AS aspect, concat_ws('/', '/lib', nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, ''), p_name) AS target,
    CASE WHEN p_retailprice * 997.3 >= 1048576 THEN printf('%.2f MB', p_retailprice * 997.3 / 1048576.0) WHEN p_retailprice * 997.3 >= 1024 THEN printf('%.1f KB', p_retailprice * 997.3 / 1024.0) ELSE printf('%d B', CAST(floor(p_retailprice * 997.3) AS BIGINT)) END AS size_text FROM part""")
def labels_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x) for x in (" Landscape", "people", "DOCUMENT ", "cat")]), (F.col("p_size") % 4 + 1).cast("int"))
    folder = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", names.content_label(word).alias("label"), names.aspect(F.col("p_size"), F.col("p_size") % 3).alias("aspect"), names.target_path("/lib", folder, F.col("p_name")).alias("target"), names.metric_text("file_size", F.col("p_retailprice") * 997.3).alias("size_text"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 6
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("asset_id"), F.concat("url", F.when(kind == 0, F.lit("/a.MOV")).when(kind == 1, F.lit("/b.jpg")).otherwise(F.lit("/c"))).alias("file_path"), F.col("url").alias("primary_file_path"),
        F.when(kind == 2, True).when(kind == 3, False).alias("is_video"), F.when(kind == 4, "video/mp4").otherwise("image").alias("mime_type"), F.when(kind == 1, "true").when(kind == 5, "no").alias("is_image"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("phash"),
    )


@query("SELECT page_id AS asset_id FROM pages WHERE page_id % 6 = 1 AND page_id % 5 <> 0")
def photo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.photo_index(_mixed(spark, sf_dir)).select("asset_id")


@query("SELECT page_id AS asset_id, 'indexed' AS video_index_status FROM pages WHERE page_id % 6 IN (0, 2, 4)")
def video_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.video_index(_mixed(spark, sf_dir)).select("asset_id", "video_index_status")


@query("""SELECT o_orderkey AS asset_id, coalesce(m.q, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS duration_sec, m.n AS frame_count
    FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_orderkey % 3 <> 0 THEN max(l_quantity) END AS q, count(*) AS n FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey""")
def video_metrics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("duration_sec"))
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("frame_count"))
    return index.with_video_metrics(base, metrics.select("asset_id", F.when(F.col("asset_id") % 3 != 0, F.col("q")).alias("duration_sec"), "frame_count"))


@query(_PHOTOS + f"SELECT img1, img2, distance, a.album AS album_1, a.phash AS phash_1, b.album AS album_2, b.phash AS phash_2 FROM ({_BLOCKED}) k JOIN (SELECT id, album, id * 3 AS phash FROM p) a ON a.id = img1 JOIN (SELECT id, album, id * 3 AS phash FROM p) b ON b.id = img2 WHERE distance <= 20")
def pair_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.enriched_pairs(photos(spark, sf_dir), {"album": F.col("album"), "phash": F.col("id") * 3}, LIMITS, "id")


@query("""WITH f AS (SELECT l_orderkey, l_partkey % 1000 AS x, l_suppkey AS y, l_quantity * 10 AS w, l_quantity * 8 AS h FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w * h DESC, x, y) AS k FROM f WHERE w >= 80 AND h >= 80 AND w * h >= 30000),
    b AS (SELECT l_orderkey, greatest(0, x - 0.25 * w) AS bx, greatest(0, y - 0.25 * h) AS by_, w * 1.5 AS bw FROM r WHERE k <= 4)
    SELECT o.l_orderkey, coalesce(count(bx), 0) AS faces, string_agg(CAST(CAST(round(bw) AS BIGINT) AS VARCHAR), ',' ORDER BY bx, by_, bw) AS widths FROM (SELECT DISTINCT l_orderkey FROM f) o LEFT JOIN b USING (l_orderkey) GROUP BY 1""")
def face_boxes_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for photos, their lines for faces."""
    face = F.struct((F.col("l_partkey") % 1000).cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), (F.col("l_quantity") * 10).alias("w"), (F.col("l_quantity") * 8).alias("h"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(face).alias("faces"))
    boxes = rows.select("l_orderkey", media.face_boxes(F.col("faces")).alias("b"))
    widths = F.array_join(F.transform("b", lambda f: F.round(f["w"]).cast("long").cast("string")), ",")
    return boxes.select("l_orderkey", F.size("b").cast("long").alias("faces"), F.when(F.size("b") > 0, widths).alias("widths"))


@query("""SELECT o_custkey, count(*) AS members, sum(o_totalprice) AS total, count(DISTINCT o_orderpriority) AS kinds, bool_or(o_orderstatus = 'F') AS any_done, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_done FROM orders GROUP BY 1""".replace("sum(o_totalprice) AS total", "round(sum(o_totalprice), 2) AS total"))
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_orderpriority").alias("kinds"), F.bool_or(done).alias("any_done"), F.max(F.when(done, F.col("o_totalprice"))).alias("best_done"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return review.without_ids(rows, rows.where(F.col("o_orderkey") % 7 == 0), "o_orderkey")[0]


@query("""SELECT o_custkey, CAST(o_custkey AS VARCHAR) || ' ' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS label FROM orders GROUP BY 1""")
def scene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.scene_labels(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Landscapes, People' WHEN 1 THEN 'Documents' ELSE '' END AS tags, CASE WHEN p_size % 5 <> 0 THEN printf('%.2f s', p_retailprice) END AS duration, printf('%.1f kbps', p_retailprice) AS rate, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS audio,
    CASE WHEN p_size % 5 <> 0 THEN p_size || ' × ' || p_partkey || ' px' END AS size_wh, CAST(p_size AS VARCHAR) AS other FROM part""")
def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts of metrics with units, tags, flags and sizes."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("landscape, cat,People", "DOCUMENT", "cat", "")]), (F.col("p_size") % 4 + 1).cast("int"))
    some = lambda c: F.when(F.col("p_size") % 5 != 0, F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", names.metric_text("content_type_scene", word).alias("tags"), names.metric_text("duration_sec_final", some("p_retailprice")).alias("duration"), names.metric_text("bitrate_kbps_final", F.col("p_retailprice")).alias("rate"), names.metric_text("audio_present_final", (F.col("p_size") % 2 == 0).cast("double")).alias("audio"), names.size_text(some("p_size"), F.col("p_partkey")).alias("size_wh"), names.metric_text("any", F.col("p_size")).alias("other"))


@query("SELECT max(CASE WHEN p_size % 3 <> 0 THEN p_retailprice END) AS _top_price, max(p_size) * 1.0 AS _top_size, CAST(NULL AS DOUBLE) AS _top_name, count(*) AS _rows FROM part")
def metric_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest number of each metric; a text column has none."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("price"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    return review.metric_maxima(rows, ["price", "size", "name"])


@query("SELECT page_id AS asset_id FROM pages WHERE page_id % 6 = 1 AND page_id % 5 <> 0 AND page_id % 4 <> 3")
def grouping_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir).withColumn("file_path", F.when(F.col("asset_id") % 4 == 3, F.lit("/x.gif")).otherwise(F.col("file_path")))
    return index.grouping_photos(rows.withColumn("width", F.lit(1)).withColumn("height", F.lit(1))).select("asset_id")


@query("""SELECT o_orderkey, l.asset_id, l.sidecar_count FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_partkey, l_suppkey)) AS asset_id, arg_min(l_suppkey, (l_partkey, l_suppkey)) AS sidecar_count FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) l ON l_orderkey = o_orderkey""")
def member_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group members get the columns of the least asset of their path."""
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"))
    own = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("file_path"), F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("sidecar_count"))
    return index.with_asset_columns(members, own).withColumnRenamed("file_path", "o_orderkey")


@query("""SELECT o_orderkey AS asset_id, m.q AS duration FROM orders LEFT JOIN (SELECT l_orderkey, min(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS q FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey""")
def duration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured durations by asset; unparsable ones are null."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise("n/a")
    return video.with_duration(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), text.alias("duration_sec")))


@query("""SELECT p_partkey, CASE WHEN r < 0.05 THEN r / 0.05 WHEN r <= 0.35 THEN 1.0 ELSE greatest(0, 1 - (r - 0.35)) END AS coverage, round(greatest(0, 1 - 1.5 * least(sqrt(pow(x - 1/3.0, 2) + pow(y - 1/3.0, 2)), sqrt(pow(x - 2/3.0, 2) + pow(y - 1/3.0, 2)), sqrt(pow(x - 1/3.0, 2) + pow(y - 2/3.0, 2)), sqrt(pow(x - 2/3.0, 2) + pow(y - 2/3.0, 2)))), 9) AS placement,
    CASE WHEN x < 0.05 OR y < 0.05 OR x + 0.25 > 0.95 OR y + 0.25 > 0.95 THEN 1.0 ELSE 0.0 END AS edge, round(greatest(0.6 * r + 0.4 * x, 0.6 * y + 0.4 * r), 9) AS subject
    FROM (SELECT p_partkey, p_size / 51.0 AS r, p_partkey % 41 / 40.0 AS x, p_partkey % 37 / 36.0 AS y FROM part)""")
def composition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, placement, edge penalty and subject score over the whole range of shares."""
    r, x, y = F.col("p_size") / 51.0, F.col("p_partkey") % 41 / 40.0, F.col("p_partkey") % 37 / 36.0
    side = F.lit(0.25)
    faces = F.array(F.struct(r.alias("area"), x.alias("center")), F.struct(y.alias("area"), r.alias("center")))
    return table(spark, sf_dir, "part").select("p_partkey", scores.face_coverage(r).alias("coverage"), F.round(scores.subject_placement(x, y), 9).alias("placement"), scores.edge_penalty(x, y, side, side).alias("edge"), F.round(scores.subject_score(faces), 9).alias("subject"))


@query("SELECT doc_id, 'p' || doc_id || '.json' AS path, 'sidecar' AS kind FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT min(doc_id), 'shared/' || lang, 'primary' FROM documents GROUP BY lang")
def deletion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path once, with the least row that has it."""
    n = F.col("doc_id")
    sides = F.when(n % 2 == 0, F.array(F.concat(F.lit("p"), n.cast("string"), F.lit(".json")))).otherwise(F.array().cast("array<string>"))
    return cleanup.deletion_paths(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("shared/"), "lang").alias("path"), sides.alias("sidecars")), "doc_id")


@query("""SELECT page_id, CAST(epoch_s AS BIGINT) AS first_positive, lower(coalesce(album, '')) AS album, printf('%d:%02d:%02d', page_id * 37 // 3600, page_id * 37 % 3600 // 60, page_id * 37 % 60) AS clock FROM (
    SELECT page_id, CASE WHEN page_id = 0 THEN NULL WHEN page_id % 3 = 0 THEN page_id WHEN page_id % 3 = 1 THEN page_id * 2 END AS epoch_s, CASE WHEN page_id % 2 = 0 THEN 'AlBum' || page_id END AS album FROM pages)""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First positive number, album key, seconds as a clock."""
    n = F.col("page_id")
    text = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, "-5").otherwise("inf")
    other = F.when(n % 3 == 1, n * 2)
    return table(spark, sf_dir, "pages").select("page_id", coerce.first_positive(text, other).cast("long").alias("first_positive"), names.album_key(F.when(n % 2 == 0, F.concat(F.lit("AlBum"), n.cast("string")))).alias("album"), coerce.seconds_text(n * 37).alias("clock"))


@query("""WITH m AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'b.png' ELSE 'c.heic' END AS name FROM part)
    SELECT p_partkey, CASE name WHEN 'a.jpg' THEN CASE WHEN p_partkey % 2 = 0 THEN '/a.jpg.json' ELSE '/a.json' END WHEN 'b.png' THEN CASE WHEN p_partkey % 2 = 0 THEN '/b.png.json' END END AS json_path FROM m""")
def sidecar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders are parity; the even folder has sidecars by name, the odd one by stem."""
    name = F.element_at(F.array(F.lit("a.jpg"), F.lit("b.png"), F.lit("c.heic")), (F.col("p_size") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("folder"), name.alias("name")).withColumn("stem", names.stem(F.col("name")))
    sides = spark.sql("SELECT * FROM VALUES (0L, 'a.jpg.json', '/a.jpg.json'), (0L, 'a.json', '/x'), (0L, 'b.png.json', '/b.png.json'), (1L, 'a.json', '/a.json') AS v(folder, name, path)")
    return joins.sidecars_of(files, sides).select("p_partkey", "json_path")


# ---------------------------------------------------------------- files, assets and shapes of tables


#: Names of the surrogate files of a page, by page_id % 6.
_NAMES = ("IMG_1.JPG", "IMG_1.JPG.json", "clip.Mov", "old.ZIP", "note", "IMG_1.json")
_NAMES_SQL = f"list_value({', '.join(repr(n) for n in _NAMES)})[page_id % 6 + 1]"
_FILES = f"""
    WITH f AS (SELECT page_id, {_NAMES_SQL} AS name, 'al' || page_id // 6 AS album, 100 * page_id AS size, 1000.5 + page_id AS stamp FROM pages),
    r AS (SELECT *, '/root/' || album || '/' || name AS path, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[.]([^.]+)$', 1)) ELSE '' END AS ext FROM f),
    t AS (SELECT *, CASE ext WHEN 'jpg' THEN 'media/photo' WHEN 'mov' THEN 'media/video' WHEN 'json' THEN 'sidecar' WHEN 'zip' THEN 'archive' ELSE 'other' END AS role FROM r)
"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a listing of files, six an album."""
    n = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (n % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("file:/root/al"), F.floor(n / 6).cast("string"), F.lit("/"), name).alias("path"), F.timestamp_micros(((1000.5 + n) * 1_000_000).cast("long")).alias("modificationTime"), (n * 100).alias("length"))


@query(_FILES + "SELECT path AS file_path, name AS file_name, ext AS extension, size AS file_size, stamp AS created_at_fs, role AS file_role, CASE role WHEN 'media/photo' THEN 'photo' WHEN 'media/video' THEN 'video' ELSE '' END AS inferred_asset_type, album AS album_path FROM t")
def raw_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.raw_files(_listed(spark, sf_dir), "/root")


@query(_FILES + "SELECT path AS file_path, size AS file_size FROM t WHERE role = 'archive'")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.archives(files.raw_files(_listed(spark, sf_dir), "/root")).select("file_path", "file_size")


@query(_FILES + """, s AS (SELECT album, min(CASE WHEN name = 'IMG_1.JPG.json' THEN path END) AS by_name, min(CASE WHEN name = 'IMG_1.json' THEN path END) AS by_stem FROM t WHERE role = 'sidecar' GROUP BY 1)
    SELECT sha1(lower(path)) AS asset_id, path AS file_path, CASE WHEN ext = 'jpg' THEN coalesce(by_name, by_stem) END AS json_path, CASE WHEN ext = 'jpg' THEN CASE WHEN by_name IS NOT NULL THEN '7' WHEN by_stem IS NOT NULL THEN '8' END END AS json_datetime, ext = 'jpg' AND coalesce(by_name, by_stem) IS NOT NULL AS has_sidecar,
           CAST(CASE WHEN ext = 'jpg' AND coalesce(by_name, by_stem) IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS sidecar_count, role = 'media/photo' AS is_image, role = 'media/video' AS is_video, CASE role WHEN 'media/video' THEN 'video' ELSE 'image' END AS mime_type, CASE WHEN page_id % 12 = 0 THEN 'document' END AS content_type_file,
           CASE WHEN role = 'media/photo' THEN CASE WHEN page_id % 12 = 0 THEN 'ok' ELSE 'failed' END END AS decode_status
    FROM t LEFT JOIN s USING (album) WHERE role LIKE 'media/%'""")
def asset_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets from a file table, with hashes, decoded images, dates and sidecars joined by path; every other photo is unreadable."""
    raw = files.raw_files(_listed(spark, sf_dir), "/root")
    number = F.col("file_size") / 100
    hashes = raw.select("file_path", F.sha2("file_path", 256).alias("sha256"))
    images = raw.where((F.col("file_role") == "media/photo") & (number % 12 == 0)).select(F.col("file_path").alias("path"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit("0f").alias("phash"), F.lit(1.0).alias("sharpness"))
    dates = raw.select(F.col("file_path").alias("path"), F.lit(None).cast("string").alias("exif_datetime"))
    sides = raw.where("file_role = 'sidecar'").select(F.col("file_path").alias("path"), F.when(F.endswith("file_name", F.lit(".JPG.json")), "7").otherwise("8").alias("json_datetime"))
    assets_ = index.assemble_assets(raw, hashes, images, dates, sides)
    return assets_.select("asset_id", "file_path", "json_path", "json_datetime", "has_sidecar", "sidecar_count", "is_image", "is_video", "mime_type", "content_type_file", "decode_status")


@query("SELECT 0.0 AS sharpness, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size * 1.0 END AS width, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS album_path, p_partkey FROM part")
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing columns and nulls get defaults, numbers are coerced, listed columns come first and private ones go."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("_hidden"), F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("width"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("album_path"))
    return tables.ordered(tables.with_defaults(rows, {"sharpness": 0.0, "width": 0, "album_path": ""}), ["sharpness", "width", "absent"], private=False)


@query("SELECT o_orderkey AS asset_id, 'features' AS part, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'semantic', o_custkey * 1.0 FROM orders")
def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two artifact tables, once per asset, of rows that repeat; columns that don't exist are left out."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_totalprice").alias("sharpness"), (F.col("o_custkey") * 1.0).alias("aesthetic_score"))
    one, two = index.split_scores(rows.union(rows), ["sharpness", "absent"], ["aesthetic_score"])
    return one.select("asset_id", F.lit("features").alias("part"), F.col("sharpness").alias("value")).union(two.select("asset_id", F.lit("semantic"), "aesthetic_score"))


@query("SELECT 'p' || l_orderkey AS file_path, l_quantity, o_custkey AS asset_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def metric_asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table by path gets the index's ids; an unknown path would be an error."""
    metric = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("file_path"), "l_quantity")
    known = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("file_path"), F.col("o_custkey").alias("asset_id"))
    return index.with_asset_ids(metric, known, "quantity")


@query("""SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 0.3 * greatest(0, 1 - 1.5 * least(sqrt(pow(cx - 1/3.0, 2) + pow(cy - 1/3.0, 2)), sqrt(pow(cx - 2/3.0, 2) + pow(cy - 1/3.0, 2)), sqrt(pow(cx - 1/3.0, 2) + pow(cy - 2/3.0, 2)), sqrt(pow(cx - 2/3.0, 2) + pow(cy - 2/3.0, 2))))
        + 0.3 * CASE WHEN a < 0.05 THEN a / 0.05 WHEN a <= 0.35 THEN 1 ELSE greatest(0, 1.35 - a) END + 0.2 * CASE WHEN x < 0.05 OR y < 0.05 OR x + w > 0.95 OR y + w > 0.95 THEN 0 ELSE 1 END + 0.2 * tilt END, 9) AS composition, round(tilt, 9) AS tilt
    FROM (SELECT *, x + w / 2 AS cx, y + w / 2 AS cy, w * w AS a, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE greatest(0, 1 - 2 * (p_size % 5 * 0.1 + 0.05)) END AS tilt FROM (SELECT p_partkey, p_size, p_partkey % 23 / 40.0 AS x, p_partkey % 19 / 36.0 AS y, 0.11 + p_size % 9 * 0.05 AS w FROM part))""")
def composition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole composition score of the larger of two faces, with the tilt of two lines."""
    x, y, w = F.col("p_partkey") % 23 / 40.0, F.col("p_partkey") % 19 / 36.0, 0.11 + F.col("p_size") % 9 * 0.05
    off = F.col("p_size") % 5 * 0.1
    angles = F.when(F.col("p_size") % 5 != 0, F.array(F.lit(1.5707963267948966) + off, F.lit(1.5707963267948966) - off - 0.1)).otherwise(F.array().cast("array<double>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", x.alias("x"), y.alias("y"), w.alias("w"), media.tilt_score(angles).alias("tilt"))
    face = lambda w: F.struct(F.col("x"), F.col("y"), w.alias("w"), w.alias("h"), F.col("tilt"))
    faces = F.when(F.col("p_size") % 7 != 0, F.array(face(F.lit(0.01)), face(F.col("w"))))
    return rows.select("p_partkey", F.round(media.composition(faces), 9).alias("composition"), F.round("tilt", 9).alias("tilt"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY 'f' || o_orderkey % 10 || '.jpg', o_orderkey % 2 = 0 DESC, '/x' || o_orderkey || '/f' || o_orderkey % 10 || '.jpg') AS at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)),
    m AS (SELECT max(o_totalprice) AS top, count(DISTINCT o_totalprice) > 1 AS differs FROM o)
    SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, 'f' || o_orderkey % 10 || '.jpg' AS file_name, o_orderkey % 2 = 0 AS is_best, CASE WHEN differs THEN o_totalprice = top END AS is_highest, o_custkey || ' × ' || o_orderkey || ' px' AS size_wh FROM o, m""")
def review_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the least customer as a review group, with their metrics."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), n.cast("string").alias("asset_id"), F.concat(F.lit("/x"), n.cast("string"), F.lit("/f"), (n % 10).cast("string"), F.lit(".jpg")).alias("file_path"), (n % 2 == 0).alias("is_best"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("width"), n.alias("height"))
    least = rows.agg(F.min("group_id")).first()[0]
    shown = review.group_rows(rows, least)
    of = lambda name, field: F.get(F.filter("metrics", lambda m: m["metric"] == name), F.lit(0))[field]
    return shown.select("asset_id", "file_name", "is_best", of("price", "is_highest").alias("is_highest"), of("size_wh", "text").alias("size_wh"))
