"""Each operator against a plain version, on the smallest tables and on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import decontamination, langid, licenses, packing, pretokens, queries, records, simhash, token_counts, topk, toxicity, url_filter
from tests import oracle

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bag(rows):
    return Counter(map(repr, rows))


@pytest.fixture(scope="module", params=["sf", "odd", "none"])
def some(request, spark, sf_dir, odd_docs, no_docs):
    return {"sf": docs(spark, sf_dir), "odd": odd_docs, "none": no_docs}[request.param]


# ---------------------------------------------------------------- licences


def test_licence_places(some):
    phrases = {tuple(p.encode().split()): x for p, x in licenses.PHRASES.items()}
    want = []
    for i, t in texts_of(some):
        w = words(t)
        want.append((i, len(w), sorted((s, x) for p, x in phrases.items() for s in range(len(w)) if tuple(w[s : s + len(p)]) == p)))
    got = [(r["doc_id"], r["n_words"], sorted((p["start"], p["label"]) for p in r["places"])) for r in licenses.scan_licences(some).collect()]
    assert bag(got) == bag(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=30))
def test_automaton_gives_longest_matches(sequences, text):
    a = licenses.SuffixAutomaton(sequences)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = length = 0
    for k, token in enumerate(text):
        state, length = a.advance(state, length, token)
        want = max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in known), default=0)
        assert length == want
        got = {n for n in a.whole[state] if length >= a.sizes[n]}
        assert got == {n for n, s in enumerate(sequences) if text[max(0, k + 1 - len(s)) : k + 1] == s}


def test_licence_chains():
    s = licenses.LicenceScanner()
    mit = next(t for t in licenses.TEMPLATES if t.startswith("permission is hereby"))
    broken = mit.replace("person obtaining", "person, anywhere, obtaining").upper()
    assert [x[0] for x in s.scan(b"some words " + broken.encode()).spans] == ["mit"]
    assert s.scan(b"Licensed under CC BY-NC 4.0.").spans == [("cc-by-nc", 0, 6, 1.0)]
    assert s.scan(b"licensed under the law of the land").spans == []
    assert s.scan(None) == licenses.Scan(0, [], [])


# ---------------------------------------------------------------- urls


def plain_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(h + p), v != "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("allow", "a.b.net", "/x"), ("block", "b.net", "/x/y"), ("block", "com", ""), ("allow", "com", ""), ("block", "", "/z"), ("block", "b.net", "/x/y")]
    urls = [None, "", "no scheme/x", "http://", "http://NET", "http://net/", "https://Sub.Example.NET/en/1?q#f", "http://example.net/en", "http://xexample.net/en/", "x://a.b.net/xyz", "x://a.b.net/x/y/z", "x://b.net/x/yy", "x://q.com?a", "x://q.com#/a", "x://org/fr/", "x://w.org/fr", "x:///z/1", "x://é.Ünet/de/", "a://b://c.net/", "x://net./en/", "x://h.net/" + "p/" * 3000, "x://a.b.net/x", "x://a.b.net/x", "x://" + "a." * 3000 + "b.net/x/y", "x://" + "net." * 2000 + "com?q"]
    pages = spark.createDataFrame([(k if k % 5 else None, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()
    want = [(k if k % 5 else None, *plain_url(u, rules)) for k, u in enumerate(urls)]
    assert bag(map(tuple, got)) == bag(want)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    none = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules).limit(0)).collect()
    assert bag(map(tuple, none)) == bag((k if k % 5 else None, *plain_url(u, [])) for k, u in enumerate(urls))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, sf_dir)) == oracle.sql_rows(oracle.connection(sf_dir), queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, d).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.8 and sum(s >= 0.5 for s in neg) <= 0.02 * len(neg)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, "t"), (6, 0, "t"), (7, 0, None), (9, None, None), (None, 1, None)], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(odd_docs, labels).collect()
    assert bag(r["doc_id"] for r in got) == bag(i for i, _ in texts_of(odd_docs))
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    untrained = toxicity.toxicity_scores(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in untrained} == {0.5}
    assert toxicity.without_toxic(odd_docs, labels.where("toxic = 0")).columns == odd_docs.columns


def plain_features(text):
    """Buckets of words, pairs and pairs over one skipped word, by unbounded integers."""
    m = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
    h, mask = [zlib.crc32(w) + 1 for w in words(text)], (1 << 64) - 1
    mixed = [x * m[0] & mask for x in h] + [(a * m[1] ^ b * m[2]) & mask for a, b in zip(h, h[1:])] + [(a * m[2] ^ b * m[3]) & mask for a, b in zip(h, h[2:])]
    return sorted({0, *(((x ^ x >> 29) * m[0] & mask) >> 44 for x in mixed)})


def plain_ftrl(rows, epochs, alpha=2.0, beta=1.0, l1=4.0):
    """FTRL-proximal with a dictionary of coordinates: the non-zero weights."""
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) * alpha / (beta + math.sqrt(n[k]))
    for _ in range(epochs):
        for own, y in rows:
            w = {k: weight(k) for k in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in own:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z if weight(k)}


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab C1é-\n."), max_size=60))
def test_features_equal_the_plain_ones(text):
    assert toxicity.features(text.encode()).tolist() == plain_features(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1, max_size=6), st.integers(0, 1)), min_size=1, max_size=40))
def test_ftrl_equals_the_plain_one(rows):
    got = toxicity.fit([(np.array(sorted(own), np.int32), y) for own, y in rows])
    want = plain_ftrl([(sorted(own), y) for own, y in rows], toxicity.EPOCHS)
    assert dict(zip(got.index.tolist(), got.value.tolist())) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_toxicity_scores_equal_the_plain_ones(spark):
    """op3's operator number by number: the choice of rows, the order of learning, the weights and the scores."""
    rng = np.random.default_rng(8)
    vocabulary, rows = [f"w{k}" for k in range(30)], []
    for i in range(240):
        rows.append((i, " ".join(rng.choice(vocabulary, 12)) + (" nasty horrid" if i % 3 == 0 else "")))
    rows += [(3, "aa the second text of an id"), (500, None), (501, "")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(230)] + [(4, 1), (500, 0), (501, 0)], "doc_id long, toxic int")
    order = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs_.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    text_hash = {(r["doc_id"], r["text"]): r["h"] for r in docs_.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    known = {i: max(int(i % 3 == 0), int(i == 4)) for i in range(230)} | {500: 0, 501: 0}
    for most, most_bytes in ((12288, 1 << 20), (100, 1 << 20), (12288, 3000)):
        use, total = [], 0
        for i in sorted((i for i in known if zlib.crc32(str(i).encode()) % 5), key=order.get)[:most]:
            own = [t for j, t in rows if j == i]
            total += max(len((t or "").encode()) for t in own)
            if total <= most_bytes:
                use.append((plain_features(min(own, key=lambda t: text_hash[(i, t)])), known[i]))
        want = plain_ftrl(use, toxicity.EPOCHS)
        got = toxicity.train(docs_, labels, most=most, most_bytes=most_bytes)
        assert dict(zip(got.index.tolist(), got.value.tolist())) == pytest.approx(want, rel=1e-4, abs=1e-4)
    want = {}
    model = toxicity.train(docs_, labels)
    weights = dict(zip(model.index.tolist(), model.value.tolist()))
    for i, t in rows:
        want[(i, t)] = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in plain_features(t))))
    got = toxicity.toxicity_scores(docs_, labels).collect()
    assert bag((r["doc_id"], round(r["score"], 5)) for r in got) == bag((i, round(w, 5)) for (i, _), w in want.items())


def test_features_don_t_depend_on_blocks(monkeypatch):
    text = b"a bad word " * 50 + "été b".encode()
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "word_blocks", lambda t: (WORD.findall(t)[k : k + 3] for k in range(0, 200, 3)))
    assert (toxicity.features(text) == whole).all()


# ---------------------------------------------------------------- near copies


def plain_fingerprint(text):
    w = [x for x in re.split(rb"[ \t-\r]+", (text or "").encode().lower()) if x]
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(pairs)), 2):
        if bin(pairs[a][1] ^ pairs[b][1]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        least[find(k)].append(i)
    return [(i, f, min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, f) in enumerate(pairs)]


def test_simhash(some):
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(some).collect()]
    small = [(i, t) for i, t in texts_of(some)]
    assert bag(got) == bag(plain_components([(i, plain_fingerprint(t)) for i, t in small]))


def test_simhash_blocks(monkeypatch):
    text = ("a b c d e f g hij " * 9).encode()
    whole = simhash.fingerprint(text)
    for size in (1, 5, 17):
        monkeypatch.setattr(simhash, "space_blocks", lambda t, s=size: (t.split()[k : k + s] for k in range(0, len(t.split()), s)))
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


@pytest.mark.parametrize("bits", [64, 30, 9, 3, 1])
def test_masks_cover_every_small_difference(bits):
    rng = np.random.default_rng(bits)
    masks = simhash.covering_masks(list(range(bits)))
    for _ in range(2000):
        flips = sum(1 << int(b) for b in set(rng.integers(0, bits, 3)))
        assert any(not m & flips for m in masks)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_dense_buckets_are_split_and_no_link_is_lost(spark, broadcast, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(2)
    free = [b for b in range(64) if not simhash.covering_masks(list(range(64)))[0] >> b & 1]
    own = {sum(int(x >> k & 1) << free[k] for k in range(10)) for x in rng.integers(0, 1 << 10, 500)} | {int(x) << 40 for x in rng.integers(1, 1 << 20, 40)}
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(own))], "fp long, doc long")
    links = {(r["src"]["fp"], r["dst"]["fp"]) for r in simhash.fingerprint_links(nodes).collect()}
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    root = {f: f for f in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(find(a) == find(b) for a, b in combinations(own, 2) if bin(a ^ b).count("1") <= 3)


def test_representatives(odd_docs, no_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    pairs = plain_components([(i, plain_fingerprint(t)) for i, t in texts_of(odd_docs)])
    texts, want = texts_of(odd_docs), []
    # components by their members, as several may share a least id
    groups = defaultdict(list)
    for (i, t), own in zip(texts, plain_roots([f for _, f, _ in pairs])):
        groups[own].append((i is None, i or 0))
    for own in groups.values():
        want.append(min(own))
    assert bag((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == bag(want)
    assert simhash.representatives(no_docs).count() == 0


def plain_roots(prints):
    root = list(range(len(prints)))
    for a, b in combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_rows_that_share_an_id_are_judged_by_their_texts(spark, broadcast, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    a, b, c, d = ("the quick brown fox jumps", "alpha beta gamma delta epsilon", "one two three four five six", "lorem ipsum dolor sit amet")
    rows = [("1", a, "x"), ("5", a, "x"), ("5", b, "x"), ("7", c, "x"), ("7", d, "x"), ("8", d, "x"), (None, c, "x"), (None, "q r s t u", "x"), (None, "q r s t u", "x"), ("9", "same row twice here", "y"), ("9", "same row twice here", "z"), ("9", "same row twice here", "y")]
    docs_ = spark.createDataFrame(rows, "doc_id string, text string, h string").repartition(3)
    got = [tuple(r) for r in simhash.representatives(docs_).collect()]
    assert bag(r[:2] for r in got) == bag([("1", a), ("5", b), ("7", c), ("7", d), (None, "q r s t u"), ("9", "same row twice here")])
    again = [tuple(r) for r in simhash.representatives(docs_.repartition(2)).collect()]
    assert bag(got) == bag(again)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs_).collect()}
    assert found == {("1", "1"), ("5", "1"), ("5", "5"), ("7", "7"), ("8", "7"), (None, "7"), (None, None), ("9", "9")}


# ---------------------------------------------------------------- decontamination


def plain_contamination(texts, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[s : s + n])):
                    found |= items_here
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def contaminated(rows):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows.collect()]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    texts = texts_of(odd_docs)
    long = next(t for i, t in texts if i == 8).split()
    items = [("a", "MIT license"), ("b", "the the the"), ("c", " ".join(long[1000:1030])), ("d", " ".join(long[5:18])), ("e", ""), ("f", None), ("a", "two words"), ("g", "the of ÉTÉ"), ("h", "same id, another"), ("c", " ".join(long[1000:1030]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, term int")
    assert bag(contaminated(decontamination.contamination(odd_docs, bench))) == bag(plain_contamination(texts, items))
    assert decontamination.contamination(no_docs, bench).count() == 0
    assert bag(contaminated(decontamination.contamination(odd_docs, bench.limit(0)))) == bag(plain_contamination(texts, []))
    clean = decontamination.without_contaminated(odd_docs, bench)
    want = [t for t, (*_, bad) in zip(texts, plain_contamination(texts, items)) if not bad]
    assert clean.columns == odd_docs.columns and bag(map(tuple, clean.select("doc_id", "text").collect())) == bag(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=7), min_size=1, max_size=4))
def test_decontamination_random(spark, texts, items):
    rows, own = [(k, " ".join(t)) for k, t in enumerate(texts)], [(str(k), " ".join(t)) for k, t in enumerate(items)]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "item_id string, text string"), window=3)
    assert bag(contaminated(found)) == bag(plain_contamination(rows, own, 3))


def test_decontamination_without_listed_anchors(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontamination, "ANCHOR_TERMS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    d, b = docs(spark, sf_dir).limit(60), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_contamination(texts_of(d), [(str(r["item_id"]), r["text"]) for r in b.collect()])
    assert bag(contaminated(decontamination.contamination(d, b))) == bag(want)


# ---------------------------------------------------------------- tokens


def library_ids(name, texts, **how):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


ENCODERS = {}


def own_encoder(name):
    from tokenizers import Tokenizer

    if name not in ENCODERS:
        path = public_tokenizers.path(name)
        ENCODERS[name] = pretokens.PretokenEncoder(path), pretokens.PretokenCounter(path, {" a": 1}), Tokenizer.from_file(path)
    return ENCODERS[name]


PARTS = [*"aAbZé Éß'sStTrevmld09 .,!-_\n\t\r<|>µ×\u00a0日\x1f\x00本。語ΣσΑς“”—€…😀𝔸𝟘İŁ١٢\u0301\x85\u3000ﬁ½Ⅳ한글ㅎ\ua7cb\u0378", "<|endoftext|>", "<|startoftext|>", "  ", "'ll"]


@pytest.mark.parametrize("block", [1 << 18, 4])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=5))
def test_pretoken_encoding_equals_the_library(block, texts):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pretokens, "BLOCK", block)
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            encoder, counter, library = own_encoder(name)
            want = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert [encoder.encode(t) for t in texts] == [raw(i) for i in want]
            assert [counter.count(t) for t in texts] == [len(i) for i in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_character_is_split_as_the_library_does(name):
    encoder, _, library = own_encoder(name)
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in (*range(0, 0x3400, 64), *range(0x9F00, 0xB000, 64), *range(0xF800, 0x11200, 64), *range(0x1D400, 0x1D800, 64), *range(0x1F300, 0x1F700, 64))]
    for t in filter(None, texts):
        assert encoder.encode(t) == raw(library.encode(t, add_special_tokens=False).ids)


def test_memos_leave_very_long_pretokens_out():
    encoder, _, _ = own_encoder("byte_bpe_50k.json")
    encoder.encode("x" * 5000 + " y")
    assert max(map(len, encoder.memo)) <= encoder.memo.KEY


def test_mixed_scripts_use_the_memo():
    encoder, _, library = own_encoder("byte_bpe_50k.json")
    text = "“Привет” — мир… 日本語。テスト 한국어 €5 emoji 😀 <|endoftext|> done " * 50
    seen, encoder._whole = [], lambda piece: seen.append(piece) or library.encode(piece, add_special_tokens=False).ids
    try:
        assert encoder.encode(text) == raw(library.encode(text, add_special_tokens=False).ids)
    finally:
        del encoder._whole
    assert set(seen) == {"<|endoftext|>"} and " Привет" not in encoder.memo and "Привет" in encoder.memo


def test_long_texts_are_split_as_short_ones(monkeypatch):
    text = "It's  a long text, isn't it?\n\n Yes 123 " * 40
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = pretokens.encoder(pretokens.vocabulary(name)).encode(text)
        monkeypatch.setattr(pretokens, "BLOCK", 7)
        assert pretokens.PretokenEncoder(pretokens.vocabulary(name), 3).encode(text) == want == raw(library_ids(name, [text])[0])
        monkeypatch.undo()


def test_token_counts(some):
    texts = texts_of(some)
    want = [(i, len((t or "").encode()), len(ids)) for (i, t), ids in zip(texts, library_ids("byte_bpe_50k.json", [t for _, t in texts]))]
    assert bag(map(tuple, token_counts.count_tokens(some).collect())) == bag(want)


def test_packing(some):
    texts = texts_of(some)
    want = Counter((i, raw([*ids, 2])) for (i, _), ids in zip(texts, library_ids("word_bpe_49k.json", [t for _, t in texts])))
    rows = packing.pack_documents(some).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["ids"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and (at & (at - 1) == 0 or at >= 4096 - packing.SLACK)
    by_size = Counter((i, len(ids) // 4) for (i, ids), n in want.items() for _ in range(n))
    assert {k: sum(len(b) // 4 for _, b in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in by_size.items()}
    for (i, ids), n in want.items():
        if by_size[(i, len(ids) // 4)] == 1:
            assert b"".join(b for _, b in sorted(pieces[(i, len(ids) // 4)])) == ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    windows = packing.best_fit_decreasing(lengths, 32)
    assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
    free, want = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(32 - n)
            want += 1
    assert len(windows) == want and Counter(32 - sum(lengths[k] for k in w) for w in windows) == Counter(free)


def test_records(some):
    texts = sorted(texts_of(some), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(map(tuple, records.round_trip(some).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in texts]
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])
    want = Counter((i, raw([*ids, 0])) for (i, _), ids in zip(texts, library_ids("byte_bpe_50k.json", [t for _, t in texts])))
    assert Counter((r[0], r[3]) for r in got) == want and all(len(r[3]) == 4 * r[2] for r in got)


def test_frames():
    data = records.frame(b"payload")
    assert records.unframe(data) == b"payload" and records.unpack_ids(records.pack_ids(raw([1, 70000]))) == raw([1, 70000])
    for k in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


def test_records_in_any_order(spark, sf_dir):
    d = docs(spark, sf_dir)
    index = records.write_records(d, records.new_path(spark, "t"))
    shuffled = records.read_records(index.orderBy(F.rand(1)).where("id % 3 = 0"))
    by_id = {r["id"]: r["ids"] for r in shuffled.collect()}
    some = [(i, t) for i, t in texts_of(d) if i % 3 == 0]
    assert by_id == {i: raw([*ids, 0]) for (i, _), ids in zip(some, library_ids("byte_bpe_50k.json", [t for _, t in some]))}


# ---------------------------------------------------------------- top k


def plain_top(rows, k, is_query):
    """(query id, rank, id, score) by unbounded integers; scores beyond a long are the nearest long."""
    most = 2**63 - 1
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(fine):
        if is_query(q):
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(own, v)))), i) for m, (i, v) in enumerate(fine) if m != n and len(v) == len(own))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_top_k_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (50, [0.5, 0.5]), (100, None), (150, [math.nan, 1.0]), (200, [None, 1.0]), (250, [math.inf, 1.0]), (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.1, 0.2]), (4, [9.0, -9.0]), (None, [1.0, 1.0]), (5, [1.0]), (300, [1e6, 1e6]), (6, []), (1, [0.1, 0.2]), (50, [0.25, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = map(tuple, topk.top_k(df, lambda i: i % 50 == 0, k=3).collect())
    assert bag(got) == bag(plain_top(rows, 3, lambda i: i % 50 == 0))
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_top_k_of_repeated_ids_and_huge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [0.25, 0.0]), (50, [1e30, -1e30]), (3, [3e38, -3e38]), (4, [-3e38, 0.0]), (5, [1e-3, 0.0]), (100, [0.0, 0.0]), (6, [2.0**40, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = plain_top(rows, 5, lambda i: i % 50 == 0)
    assert (0, 1, 3, 2**63 - 1) in want and (50, 1, 0, 2**63 - 1) in want and (0, 4, 1, 65536) in want
    assert bag(map(tuple, topk.top_k(df, lambda i: i % 50 == 0).collect())) == bag(want)


def test_lists_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert bag(map(tuple, topk.top_k(df, lambda i: i % 20 == 0, k=4).collect())) == bag(plain_top(rows, 4, lambda i: i % 20 == 0))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 9), st.integers(1, 4), st.integers(0, 10_000), st.sampled_from([2, 1000, 1 << 28, 1 << 40, 1 << 61]))
def test_tile_top(n, q, k, seed, size):
    rng = np.random.default_rng(seed)
    tile, queries_ = (np.floor(rng.integers(-size, size, (m, 3)) * rng.choice([1.0, 1e-6], (m, 1))) for m in (n, q))
    ids, asked = rng.integers(0, 9, n), rng.permutation(20)[:q].astype(np.int64)
    rows = rng.permutation(20)[:n].astype(np.int64)
    scores, found = topk.tile_top(queries_, asked, tile, rows, ids, k)
    scores, found = topk.merge_top(np.full((q, k), topk.ABSENT), np.zeros((q, k), np.int64), scores, found, k)
    most = 2**63 - 1
    for a, v, s, f in zip(asked.tolist(), queries_.tolist(), scores.tolist(), found.tolist()):
        best = sorted((-max(-most, min(most, sum(int(x) * int(y) for x, y in zip(v, t)))), i) for r, i, t in zip(rows.tolist(), ids.tolist(), tile.tolist()) if r != a)[:k]
        assert [(-x, i) for x, i in zip(s, f) if x != topk.ABSENT] == best


def test_query_blocks(spark, sf_dir, monkeypatch):
    want = oracle.spark_rows(queries.op7_topk(spark, sf_dir))
    for name, value in (("BLOCK_VALUES", 200), ("QUERY_ROWS", 3), ("TILE_ROWS", 17)):
        monkeypatch.setattr(topk, name, value)
    assert oracle.spark_rows(queries.op7_topk(spark, sf_dir)) == want


# ---------------------------------------------------------------- language


def test_language(spark):
    rows = langid.identify_languages(docs(spark, "/root/testdata/sf0.01")).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(odd_docs, no_docs):
    got = langid.identify_languages(odd_docs).collect()
    by_text = {t: r for (_, t), r in zip(texts_of(odd_docs), got)}
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [by_text[t]["lang_pred"] for t in (None, "", "12345 --- !!!")] == ["und"] * 3
    assert langid.identify_languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.with_language(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in texts_of(odd_docs))


def test_language_sums_don_t_depend_on_neighbours(spark, odd_docs, sf_dir, monkeypatch):
    model = langid.train(docs(spark, sf_dir))
    texts = [t for _, t in texts_of(docs(spark, sf_dir))][:40] + ["", "é", "12", "a b", "日本語"]
    together = model._sums(texts)[0]
    for size in (100, 64, 7):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert np.allclose(model._sums(texts)[0], together)
        assert np.allclose([model._long_sums(t)[0] for t in texts if t], together[[k for k, t in enumerate(texts) if t]])
    assert np.allclose(np.concatenate([model._sums([t])[0] for t in texts]), together)


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    original, own, left = docs(spark, sf_dir), docs(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, sf_dir)
        assert own.columns == original.columns
        left.append(own.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0.7 * original.count()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in own.select("doc_id").collect()}
