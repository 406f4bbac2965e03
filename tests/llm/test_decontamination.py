"""Proximity and items without id of the decontamination operator, against a plain version and the SQL."""

import random
import shutil
from collections import Counter

import pytest

from quarrymill.llm import decontamination, queries
from tests import oracle
from tests.llm.test_brute_force import bag, docs, texts_of, words


def plain_proximity(texts, items, size=13):
    counts = Counter(w for _, t in texts for w in words(t))
    windows = set()
    for _, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            at = min((counts[w[k]], w[k], k) for k in range(s, s + n))[2]
            windows.add((tuple(w[s : s + n]), at - s))
    out = []
    for i, t in texts:
        w, near, hit = words(t), set(), set()
        for window, at in windows:
            others = set(window) - {window[at]}
            for p in (k for k, x in enumerate(w) if x == window[at]):
                if p >= at and tuple(w[p - at : p - at + len(window)]) == window:
                    hit.add(p)
                if 2 * len(others & set(w[max(0, p - size + 1) : p + size])) > len(others):
                    near.add(p)
        out.append((i, len(near - hit)))
    return out


def proximity(rows):
    return [(r["doc_id"], r["n_proximity"]) for r in rows.collect()]


def test_near_passage_round_a_lone_anchor(spark):
    item = [f"w{k}" for k in range(25)]
    broken = [*item[:5], "x", *item[6:18], "y", *item[19:]]
    filler = " ".join(w for w in item if w != "w12")
    rows = [(1, " ".join(broken)), (2, "w12 alone"), (3, " ".join(item)), (4, " ".join(["x", *item[6:15], "y"])), (6, " ".join([*item[12:19], "q"])), (7, " ".join([*item[12:20], "q"])), (7, " ".join([*item[12:20], "q"]))]
    rows += [(5, filler)] * 8
    items = [("a", " ".join(item))]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = proximity(found)
    assert bag(got) == bag(plain_proximity(rows, items))
    assert bag(got) == bag([(1, 1), (2, 0), (3, 0), (4, 1), (6, 0), (7, 1), (7, 1)] + [(5, 0)] * 8)


def test_proximity_of_tables(spark, sf_dir):
    b = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(5)
    rows = texts_of(docs(spark, sf_dir).limit(60))
    for k, (_, text) in enumerate(b):
        w = text.split()
        for n in range(len(w)):
            if rng.random() < 0.15:
                w[n] = "changed"
        rows.append((1_000_000 + k, " ".join(w)))
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(b, "item_id string, text string"))
    want = plain_proximity(rows, b)
    assert sum(n for _, n in want) > 0 and bag(proximity(found)) == bag(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_proximity_of_few_words(spark, seed):
    rng = random.Random(seed)
    text = lambda n, of: " ".join(rng.choice(of) for _ in range(rng.randrange(n)))
    rows, items = [(k, text(14, "abcdefg")) for k in range(40)], [(str(k), text(9, "abcdefgh")) for k in range(8)]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=4)
    assert bag(proximity(found)) == bag(plain_proximity(rows, items, 4))


def test_items_without_id_are_hit(spark, tmp_path):
    words_ = [f"w{k}" for k in range(60)]
    passage = lambda a, b: " ".join(words_[a:b])
    rows = [(1, passage(0, 20)), (2, passage(20, 40)), (3, passage(0, 40)), (4, passage(40, 60)), (5, passage(15, 60)), (None, passage(20, 40)), (6, None)]
    items = [(None, passage(0, 20)), (None, passage(20, 34)), (7, passage(20, 40)), (None, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", d), ("benchmark", b)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*")).rename(tmp_path / f"{name}.parquet")
        shutil.rmtree(tmp_path / name)
    got = oracle.spark_rows(queries.op5_decontamination(spark, str(tmp_path)))
    assert got == oracle.sql_rows(oracle.connection(str(tmp_path)), queries.ORACLE_SQL["op5_decontamination"])
    found = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(d, b).where("doc_id is not null").collect()}
    assert found == {1: (20, [None], True), 2: (20, ["7", None], True), 3: (40, ["7", None], True), 4: (0, [], False), 5: (20, ["7", None], True), 6: (0, [], False)}
    assert [r["doc_id"] for r in decontamination.without_contaminated(d, b).orderBy("doc_id").collect()] == [4, 6]
