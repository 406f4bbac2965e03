"""URL filters: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymill.plans.storage import stored

#: Hex digits of a digest that are joined on before the full digests are compared.
PREFIX_DIGITS = 8
#: Rule tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Of larger ones, rules that at least 1/HEAVY of all expressions meet are broadcast; there are at most HEAVY such prefixes.
HEAVY = 1000
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and its parent domains, those of at most ``labels`` labels."""
    parts = F.split(host, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(parts) - (labels - 1))
    return F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def path_prefixes(path: Column, length: int, rests: list[int]) -> Column:
    """The prefixes that rules may have: those ending with a slash, and the empty one, each with the next r characters for every r of ``rests``.

    ``length`` bounds the part up to the slash; what follows it has no slash.
    """
    parts = F.split(path, "/", -1)

    def own(k: Column) -> Column:
        base = F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
        rest = F.element_at(parts, k + 1)
        return F.filter(F.array(*[F.when((F.length(base) <= length) & (F.length(rest) >= r), F.concat(base, F.substring(rest, 1, r))) for r in rests]), lambda x: x.isNotNull())

    most = F.least(F.size(parts) - 1, F.lit(length))
    return F.flatten(F.transform(F.sequence(F.lit(0), most), own))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, prefix).cast("binary"), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path)."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of ``pages``.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path.  The longest fitting rule (host and path together) wins, of
    equals a block, then the smaller text.  Without a rule the verdict is
    ``allow``.  Each url becomes expressions: a parent domain with a path prefix
    that ends with a slash or as many characters after one as some rule has.  So
    a fitting rule's own host and path are one of them, and both meet in a join
    on short digest prefixes; full digests confirm.  All expressions of a row are
    folded where it lies, so the one shuffle moves a row per page.  A large rule
    table is shuffled, but for the prefixes that very many expressions meet.
    Null urls and urls without ``://`` have empty host and path.  Ids may be
    null; repeated rows stay repeated.  Rules with a null host, path or verdict
    are ignored; repeated rules count once.
    """
    usable = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    folded = usable.groupBy("host", "path").agg(F.min(F.struct((F.col("verdict") != "block").alias("late"), "verdict")).alias("v"))
    base = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    rule = F.struct(_digest(F.col("host"), F.col("path")).alias("full"), F.col("v.verdict").alias("verdict"), "host", "path")
    filed = folded.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length(base).alias("base"), (F.length("path") - F.length(base)).alias("rest"), rule.alias("r"))
    rows, labels, length, rests = filed.agg(F.count(F.lit(1)), F.max("labels"), F.max("base"), F.array_sort(F.collect_set("rest"))).first()
    by_short = filed.groupBy(F.substring("r.full", 1, PREFIX_DIGITS).alias("short")).agg(F.collect_list("r").alias("rules"))
    split = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    hosts, paths = host_suffixes(F.col("host"), labels or 1), path_prefixes(F.col("path"), length or 0, rests or [0])
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(h, p))))
    none = F.array(F.lit(None).cast("string"))  # keeps urls without any expression
    each = split.select("id", "host", "path", F.posexplode(F.concat(none, expressions)).alias("pos", "own")).withColumn("short", F.substring("own", 1, PREFIX_DIGITS))
    joined = _met(each, by_short, rows)
    fitting = F.filter("rules", lambda r: r["full"] == F.col("own"))
    ranked = F.transform(fitting, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("length"), (r["verdict"] != "block").alias("late"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    found = joined.groupBy("id", "host", "path").agg(F.min(F.array_min(ranked)).alias("best"), F.count_if(F.col("pos") == 0).alias("n"))
    each_copy = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each_copy.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict"))


def _met(each: DataFrame, by_short: DataFrame, rows: int) -> DataFrame:
    """Expressions with the rules of their short prefix, if there are any."""
    if rows <= BROADCAST_ROWS:
        return each.join(F.broadcast(by_short), "short", "left")
    counts = stored(each.where("short IS NOT NULL").groupBy("short").agg(F.count(F.lit(1)).alias("n")), "expressions")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY >= total + HEAVY).select("short"))
    many = F.broadcast(by_short.join(heavy, "short"))
    light = each.join(heavy, "short", "left_anti").join(by_short, "short", "left")
    return light.union(each.join(heavy, "short").join(many, "short", "left").select(light.columns))
