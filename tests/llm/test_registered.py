"""The registered queries and the pipeline, as they are called, against plain versions on odd and planted rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import langid, licenses, packing, queries, toxicity, url_filter
from tests import oracle
from tests.llm.test_brute_force import bag, library_ids, plain_components, plain_contamination, plain_features, plain_fingerprint, plain_ftrl, plain_roots, plain_url, raw, texts_of, words

EN = "the and of to in is that it was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when".split()
FR = "le la les des une est dans qui que pour pas sur avec sont plus par mais comme tout nous vous leur bien cette deux même aussi sans être fait entre".split()
BAD = "vile nasty horrid".split()


def made_rows():
    """(doc_id, text, lang): two languages, toxic texts, copies, benchmark passages, licences and odd rows."""
    rng = random.Random(11)
    passage = lambda of, n: " ".join(rng.choice(of) + rng.choice(["", "s", "ed", "er"]) for _ in range(n))
    items = [(k, passage(EN, 20)) for k in range(4)] + [(9, "one two three"), (None, passage(FR, 15)), (10, None), (11, "")]
    rows = []
    for i in range(90):
        of, lang = (EN, "en") if i % 2 else (FR, "fr")
        text = passage(of, rng.randrange(25, 90))
        if i % 6 == 0:
            text += " " + " ".join(BAD) + " " + passage(of, 5)
        if i in (7, 8):
            text = items[i % 4][1] + " " + text[:100]
        if i == 21:
            text += " under the MIT License, see the Apache License or GNU General Public License"
        rows.append((i, text, lang))
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in (1, 3, 5)]  # exact copies
    rows += [(110, rows[9][1] + " end", "en"), (3, "a second text under the number three which is quite unlike", "en"), (3, rows[11][1], "fr")]
    rows += [(None, None, None), (None, "", "en"), (200, None, "fr"), (201, "", None), (202, " \t\n ", "en"), (203, "12345 --- !!!", "fr"), (None, rows[13][1], "en"), (None, passage(FR, 30), "fr"), (204, "日本語のテキスト。“x” — ☃ 😀 <|endoftext|> fin", None), (205, passage(EN, 3000), "en"), (206, "one two three", "en"), (206, "one two three", "en")]
    return rows, items


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    rows, items = made_rows()
    folder = tmp_path_factory.mktemp("made")
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), "h": [1] * len(rows), "id": ["x"] * len(rows)})
    marks = [(i, 1, int(i % 6 == 0)) for i in range(0, 90) if i % 7] + [(5, 0, None), (None, 1, 1), (200, 1, 0)]
    tables = {"documents": docs, "labels": pa.table({"doc_id": pa.array([m[0] for m in marks], pa.int64()), "quality": pa.array([m[1] for m in marks], pa.int32()), "toxic": pa.array([m[2] for m in marks], pa.int32())}), "benchmark": pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})}
    for name, table in tables.items():
        pq.write_table(table, folder / f"{name}.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for name, table in tables.items():
        pq.write_table(table.slice(0, 0), empty / f"{name}.parquet")
    return str(folder), str(empty), rows, items, marks


def test_op1_base_columns(spark, made):
    folder, _, rows, _, _ = made
    phrases = {tuple(p.encode().split()): x for p, x in licenses.PHRASES.items()}
    want = []
    for i, t, _ in rows:
        w = words(t)
        places = [(s, x) for p, x in phrases.items() for s in range(len(w)) if tuple(w[s : s + len(p)]) == p]
        starts = [s for s, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    found = queries.op1_license_scan(spark, folder).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == bag(want)
    for r in found:
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        assert (r["score"] == 1.0) if r["n_base"] else True
    # the same columns by SQL, over whole tables
    sql = r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT rid, s - 1 AS s, CASE WHEN w[s] = 'mit' AND w[s + 1] = 'license' THEN 'mit' WHEN w[s] = 'apache' AND w[s + 1] = 'license' THEN 'apache' WHEN w[s] = 'general' AND w[s + 1] = 'public' AND w[s + 2] = 'license' THEN 'gpl' END AS label
              FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS s FROM d)),
        g AS (SELECT rid, count(*) AS n, min(s) AS a, max(s) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)"""
    for where in (folder, "/root/testdata/sf0.01"):
        got = oracle.spark_rows(queries.op1_license_scan(spark, where).drop("labels", "score"))
        assert got == oracle.sql_rows(oracle.connection(where), sql)


def test_op4_columns(spark, made):
    folder, empty, rows, _, _ = made
    want = [(i, f"{f:016x}", c) for i, f, c in plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows])]
    assert bag(map(tuple, queries.op4_simhash(spark, folder).collect())) == bag(want)
    assert queries.op4_simhash(spark, empty).count() == 0


def crc(ids):
    return zlib.crc32(raw(ids))


def test_op6_columns(spark, made):
    folder, empty, rows, _, _ = made
    own = defaultdict(list)
    for (i, _, _), ids in zip(rows, library_ids("word_bpe_49k.json", [t for _, t, _ in rows])):
        own[i, len(ids) + 1].append([*ids, 2])
    sequences, tokens = defaultdict(list), Counter()
    for r in queries.op6_packing(spark, folder).collect():
        assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in own[r["doc_id"], r["doc_tokens"]])
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == {k: k[1] * len(v) for k, v in own.items()}
    for placed in sequences.values():
        ends = [o + n for o, n in sorted(placed)]
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert queries.op6_packing(spark, empty).count() == 0


def test_op9_and_op10_columns(spark, made):
    folder, empty, rows, _, _ = made
    ids = library_ids("byte_bpe_50k.json", [t for _, t, _ in rows])
    want = [(i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t, _), x in zip(rows, ids)]
    assert any(w[3] for w in want) and bag(map(tuple, queries.op9_token_counts(spark, folder).collect())) == bag(want)
    got = sorted(queries.op10_records(spark, folder).collect(), key=lambda r: r["start"])
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((i, len(x) + 1, crc([*x, 0])) for (i, _, _), x in zip(rows, ids))
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1])
    assert queries.op9_token_counts(spark, empty).count() == queries.op10_records(spark, empty).count() == 0


# ---------------------------------------------------------------- language


def plain_grams(text):
    """Buckets of the 1- to 3-grams of lower-cased letters, every other character a blank."""
    s = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    s, out = [32, *s, 32, 32, 32], []
    for i in range(len(s) - 2):
        if s[i] != 32 or s[i + 1] != 32:
            mixed = 0
            for c, m in zip(s[i : i + 3], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                mixed = (mixed ^ c) * m & 0xFFFFFFFF
                out.append(((mixed ^ mixed >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> 16)
    return out


def plain_bayes(spark, rows):
    """(prior, counts, totals) by dictionaries; of rows that repeat an id the one of least hash."""
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    hashes = {(r["lang"], r["text"]): r["h"] for r in spark.createDataFrame(usable, "doc_id long, text string, lang string").select("lang", "text", F.xxhash64("lang", "text").alias("h")).collect()} if usable else {}
    chosen = {}
    for i, t, x in usable:
        if i not in chosen or hashes[x, t] < hashes[chosen[i][1], chosen[i][0]]:
            chosen[i] = t, x
    counts, seen = defaultdict(Counter), Counter()
    for t, x in chosen.values():
        counts[x].update(plain_grams(t))
        seen[x] += 1
    return counts, seen


def plain_language(text, counts, seen):
    if not any(c.isalpha() for c in text or "") or not seen:
        return "und", 0.0
    sums = {}
    for x in counts:
        total = sum(counts[x].values()) + 0.5 * 65536
        sums[x] = math.log(seen[x] / sum(seen.values())) + sum(math.log((counts[x][g] + 0.5) / total) for g in plain_grams(text))
    best = max(sorted(sums), key=sums.get)
    return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())


def test_op8_equals_plain_bayes(spark, made):
    folder, empty, rows, _, _ = made
    counts, seen = plain_bayes(spark, rows)
    assert set(seen) == {"en", "fr"}
    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    for k, x in enumerate(model.languages):
        total = sum(counts[x].values()) + 0.5 * 65536
        want = np.array([math.log((counts[x][g] + 0.5) / total) for g in range(65536)])
        assert np.allclose(model.table[:, k], want, atol=1e-5) and model.prior[k] == pytest.approx(math.log(seen[x] / sum(seen.values())))
    got = queries.op8_langid(spark, folder).collect()
    want = [(i, *plain_language(t, counts, seen)) for i, t, _ in rows]
    assert bag((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got) == bag((i, x, round(s, 3)) for i, x, s in want)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert queries.op8_langid(spark, empty).count() == 0


def test_language_stage_parameters(spark, made):
    folder, _, rows, _, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts, seen = plain_bayes(spark, rows)
    judged = [(i, t, *plain_language(t, counts, seen)) for i, t, _ in rows]
    kept = langid.with_language(docs, languages=["fr"], least=0.9)
    assert kept.columns == docs.columns and bag(texts_of(kept)) == bag((i, t) for i, t, x, s in judged if x == "fr" and s >= 0.9)


# ---------------------------------------------------------------- urls and packing


@pytest.mark.parametrize(("broadcast", "heavy"), [(0, 1000), (0, 8), (100_000, 1000)])
def test_large_rule_tables_and_common_hosts(spark, broadcast, heavy, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(url_filter, "HEAVY", heavy)
    rng = random.Random(heavy)
    rules = [("block", "hot.com", f"/x{k}") for k in range(300)] + [("allow", "com", ""), ("block", "hot.com", "/a/"), ("allow", "a.hot.com", "/a/bc"), ("block", "HOT.com", "/a/b"), ("allow", "org", "/é/"), ("block", "org", "/é/ü")]
    hosts = ["hot.com"] * 6 + ["a.hot.com", "b.a.hot.com", "hot.org", "org", "cold.net"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/x', '/a/', '/a/b', '/a/bcd/e', '/é/', '/é/üx', ''])}{rng.randrange(400)}" for _ in range(400)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()
    plain = [(v, "".join(c.lower() if "A" <= c <= "Z" else c for c in h), p) for v, h, p in rules]
    assert bag(map(tuple, got)) == bag((k, *plain_url(u, plain)) for k, u in enumerate(urls))


def test_underfilled_windows_go_on(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "word " * rng.randrange(2, 200)) for k in range(400)], "doc_id long, text string").coalesce(1)
    found = {}
    for block in (4000, 10**9):
        rows = packing.pack_documents(docs, window=256, block_tokens=block).collect()
        assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
        sizes = Counter()
        for r in rows:
            sizes[r["sequence_id"]] += r["length"]
        assert all(n & (n - 1) == 0 or n >= 256 - packing.SLACK for n in sizes.values())
        found[block] = sum(n < 128 for n in sizes.values()) / len(sizes)
    assert found[10**9] < 0.1 and found[4000] < 0.15


def test_pieces_that_never_fill_a_window_are_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 140) for k in range(200)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, window=256, block_tokens=1000).collect()
    assert sum(r["length"] for r in rows) == 200 * 141


# ---------------------------------------------------------------- pipeline


def plain_stages(spark, rows, items, marks):
    """The rows (id, text, lang) that each stage keeps."""
    counts, seen = plain_bayes(spark, rows)
    kept = [r for r in rows if (p := plain_language(r[1], counts, seen))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    yield kept
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t, _ in kept], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    ids = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i, *_ in marks if i is not None], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    label = {}
    for i, _, y in marks:
        if i is not None and y is not None:
            label[i] = max(label.get(i, 0), y)
    own = defaultdict(list)
    for i, t, _ in kept:
        own[i].append(t)
    train = [(plain_features(min(own[i], key=hashes.get)), label[i]) for i in sorted(label, key=lambda i: (ids[i], i)) if i in own and zlib.crc32(str(i).encode()) % 5]
    weights = plain_ftrl(train, toxicity.EPOCHS)
    kept = [r for r in kept if sum(weights.get(k, 0.0) for k in plain_features(r[1])) < 0]
    yield kept
    groups = defaultdict(list)
    for r, root in zip(kept, plain_roots([plain_fingerprint(t) for _, t, _ in kept])):
        groups[root].append(r)
    chosen = []
    for own in groups.values():
        # of several texts under the least id the one of least fingerprint
        prints = {r: plain_fingerprint(r[1]) for r in own}
        signed = lambda f: f - (1 << 64) if f >> 63 else f
        chosen.append(min(own, key=lambda r: (r[0] is None, r[0] or 0, signed(prints[r]))))
    kept = chosen
    yield kept
    judged = plain_contamination([(i, t) for i, t, _ in kept], [(str(i), t) for i, t in items])
    kept = [r for r, (*_, bad) in zip(kept, judged) if not bad]
    yield kept


def test_pipeline_equals_the_plain_one(spark, made):
    folder, empty, rows, items, marks = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, len(rows)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(spark, rows, items, marks)):
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert bag(texts_of(docs)) == bag((i, t) for i, t, _ in want), name
        assert len(want) < left, name
        left = len(want)
    found = corpus_pipeline.run(spark, folder).collect()
    ids = library_ids("word_bpe_49k.json", [t for _, t, _ in want])
    assert Counter(r["doc_id"] for r in found if r["start"] == 0) == Counter(i for i, _, _ in want)
    own = defaultdict(list)
    for (i, _, _), x in zip(want, ids):
        own[i, len(x) + 1].append([*x, 2])
    assert all(any(crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in own[r["doc_id"], r["doc_tokens"]]) for r in found)
    assert sum(r["length"] for r in found) == sum(len(x) + 1 for x in ids)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, made):
    folder = made[0]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == odd_docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0) == (docs.count() > 0)


def test_public_vocabularies_stay_outside_the_repository():
    assert "/repo/" not in public_tokenizers.path("byte_bpe_50k.json")
