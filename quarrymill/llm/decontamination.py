"""Benchmark decontamination over a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.plans.storage import stored

WINDOW = 13
#: Contaminated: hits, and at least one in so many words is hit.
ONE_IN = 20
#: Tables made from the benchmark are broadcast, and its anchor terms listed, up to so many rows.
BROADCAST_ROWS = 50_000
ANCHOR_TERMS = 50_000


def words_of(text: Column) -> Column:
    """The words of a text, as an array of strings.

    The text's UTF-8 bytes are read as Latin-1, so lower-casing and the word
    class see bytes: A-Z are lowered, and so, one to one, are lead bytes of
    other characters.  Different words stay different, which is all that
    matching needs.  Null has no words.
    """
    plain = F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.coalesce(F.array_remove(F.split(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_terms(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """One row (item_id, item words, pos, term) per word of every item that has words."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("item"))
    return words.where(F.size("item") > 0).distinct().select("item_id", "item", F.posexplode("item").alias("pos", "term"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, rows: int, text_col: str) -> DataFrame:
    """How often each benchmark term stands in all documents; absent terms count 0."""
    tokens = docs.select(F.explode(words_of(F.col(text_col))).alias("term"))
    found = tokens.join(_small(vocabulary, rows), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The anchors of all windows: (term, item_id, anchor, lo, hi, w, span, core).

    A window's anchor is its rarest term's place (of equals the first).  Windows
    of an item that share an anchor are one probe: their starts are lo..hi, span
    holds their words, and core the words that all of them hold.
    """
    placed = terms.join(counts, "term")
    w = F.least(F.size("item"), F.lit(window))
    starts = placed.select("*", w.alias("w"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - w + 1), F.least(F.col("pos"), F.size("item") - w))).alias("start"))
    rarest = starts.groupBy("item_id", "item", "w", "start").agg(F.min(F.struct("n", "term", "pos")).alias("a"))
    merged = rarest.groupBy("item_id", "item", "w", F.col("a.term").alias("term"), F.col("a.pos").alias("anchor")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    span = F.slice("item", F.col("lo") + 1, F.col("hi") + F.col("w") - F.col("lo"))
    core = F.slice("item", F.col("hi") + 1, F.col("lo") + F.col("w") - F.col("hi"))
    return merged.select("term", "item_id", "anchor", "lo", "hi", "w", span.alias("span"), core.alias("core"))


def postings(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """The positional index of the anchor terms: (id, h, n_words, term, pos, first, context).

    Each posting carries the up to 2*window-1 words around its place, of which
    the first stands at ``first``.  Every row of ``docs`` also has one posting
    without a term, so that rows without matches are kept and copies counted.
    ``h`` is the text's 64-bit hash.
    """
    listed = [r["term"] for r in anchors.limit(ANCHOR_TERMS + 1).collect()]
    worded = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("words"))
    places = F.transform("words", lambda t, k: F.struct(k.alias("pos"), t.alias("term")))
    chosen = F.filter(places, lambda x: x["term"].isin(listed)) if len(listed) <= ANCHOR_TERMS else places

    def around(x: Column) -> Column:
        first = F.greatest(F.lit(0), x["pos"] - (window - 1))
        return F.struct(x["term"].alias("term"), x["pos"].alias("pos"), first.alias("first"), F.slice("words", first + 1, x["pos"] + window - first).alias("context"))

    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("pos"), F.lit(-1).alias("first"), F.array().cast("array<string>").alias("context")))
    rows = worded.select("id", "h", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(none, F.transform(chosen, around))).alias("p"))
    return rows.select("id", "h", "n_words", "p.*")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact phrase matches of benchmark windows: one row per row of ``docs``.

    (id, h, n_words, n_hit, items, n_proximity, contaminated): words of the
    document, those inside an occurrence of a window, the sorted ids of the items
    with occurring windows, the places of anchor terms near which over half of a
    window's other words stand though no window does, and whether there are hits
    on at least one in ONE_IN words.  A window is ``window`` consecutive words of
    an item, or a shorter item as a whole; items without words have none.

    The index holds the postings of the rarest term of each window, by counts
    over all documents.  A posting is shifted by its term's place in the item,
    and the words shared by all windows there, then each window, are intersected
    with its context.  Nearness is judged for each window by its different words
    other than the anchor term.  Postings of a document lie together, so they are folded
    before the only shuffle, which moves about a row per document.  Null and
    empty texts have no words.  Null ids are allowed; rows that repeat id and
    text are counted and given back as often; items with a
    null id are searched too, and stand as one null at the end of the items.
    """
    terms = stored(benchmark_terms(items, item_id, item_text, window), "benchmark-terms")
    vocabulary = terms.select("term").distinct()
    counts = stored(term_counts(docs, vocabulary, vocabulary.count(), text_col), "term-counts")
    own = stored(probes(terms, counts, window), "probes")
    index = stored(postings(docs, own.select("term").distinct(), id_col, text_col, window), "postings")
    joined = index.join(_small(own, own.count()), "term", "left")
    at = F.col("pos") - F.col("anchor")  # where the item's first word would stand
    core_at = at + F.col("hi") - F.col("first")
    exact = F.when(core_at >= 0, F.slice("context", core_at + 1, F.size("core")) == F.col("core")).otherwise(F.lit(False))
    standing = F.filter(F.sequence(F.col("lo"), F.col("hi")), lambda s: F.when(at + s >= F.col("first"), F.slice("context", at + s - F.col("first") + 1, F.col("w")) == F.slice("span", s - F.col("lo") + 1, F.col("w"))).otherwise(F.lit(False)))
    hits = F.when(exact, F.transform(standing, lambda s: at + s)).otherwise(F.array().cast("array<int>"))

    def half(s: Column) -> Column:  # the anchor term itself is in the window and in the context
        here = F.slice("span", s - F.col("lo") + 1, F.col("w"))
        return (F.size(F.array_intersect(here, F.col("context"))) - 1) * 2 > F.size(F.array_distinct(here)) - 1

    near = F.col("term").isNotNull() & F.exists(F.sequence(F.col("lo"), F.col("hi")), half)
    judged = joined.select("id", "h", "n_words", "term", "pos", "item_id", "w", F.when(F.col("term").isNotNull(), hits).alias("hits"), F.coalesce(near, F.lit(False)).alias("near"))
    judged = judged.where(F.col("term").isNull() | (F.size("hits") > 0) | F.col("near"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s, s + F.col("w") - 1))))
    folded = judged.select("id", "h", "n_words", F.col("term").isNull().alias("base"), F.when(F.col("near"), F.col("pos")).alias("near"), F.when(F.size("hits") > 0, F.col("pos")).alias("at"), F.when(F.size("hits") > 0, F.struct("item_id")).alias("item"), F.when(F.size("hits") > 0, covered).alias("places"))
    per = folded.groupBy("id", "h", "n_words").agg(F.count_if("base").cast("int").alias("copies"), F.size(F.array_except(F.collect_set("near"), F.collect_set("at"))).cast("long").alias("n_proximity"), F.collect_set("item").alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"))
    whole = per.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))
    return whole.select(F.col("id").alias(id_col), "h", "n_words", "n_hit", F.array_sort(F.transform("items", lambda x: x["item_id"])).alias("items"), "n_proximity", dirty.alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = contamination(docs, items, id_col, text_col, **names)
    bad = stored(found.where("contaminated").select(F.col(id_col).alias("__bad_id"), F.col("h").alias("__bad_h")).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(text_col) == F.col("__bad_h"))
    return docs.join(bad, same, "left_anti")
