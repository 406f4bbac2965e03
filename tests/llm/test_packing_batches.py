"""What a packing task hands back at a time."""

from unittest.mock import MagicMock

import pyarrow as pa

from quarrymill.llm import packing


def test_output_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "F", MagicMock())
    monkeypatch.setattr(packing, "bound_batches", lambda spark: None)
    docs = MagicMock()
    source = docs.select.return_value
    source.dtypes = [("id", "bigint"), ("text", "string")]
    packing.pack_documents(docs)
    run = source.mapInArrow.call_args[0][0]
    texts = ["some words " * 400_000] + ["a few " * (k % 900) for k in range(600)]
    given = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(run(iter([given])))
    sizes = [sum(map(len, b.column("ids").to_pylist())) for b in out]
    assert len(sizes) > 2 and max(sizes) <= packing.OUT_BYTES + 4 * packing.WINDOW
    rows = pa.Table.from_batches(out).to_pylist()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert len(by_doc) == len(texts)
    assert all(sum(n for _, n, _ in v) == v[0][2] and len({s for s, _, _ in v}) == len(v) for v in by_doc.values())
