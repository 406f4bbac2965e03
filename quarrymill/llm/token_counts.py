"""Token counts by a map-side two-tier lookup."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.llm.pretokens import PretokenCounter, encoder, vocabulary
from quarrymill.llm.texts import ROWS, bound_batches, worker_state
from quarrymill.plans.storage import stored

#: Pre-tokens in a task's summary of its frequent ones, and in the table that is broadcast.
#: They decide speed only: every count is exact without them.
SUMMARY, FREQUENT = 8192, 50_000
#: Summaries that are merged into one, and that the driver merges at the end.
FAN = 64


class Summary:
    """Frequent pre-tokens of a stream in bounded memory: beyond four times ``most`` only the ``most`` commonest go on."""

    def __init__(self, most: int = SUMMARY):
        self.most, self.seen = most, Counter()

    def add(self, counts) -> None:
        self.seen.update(counts)
        if len(self.seen) > 4 * self.most:
            self.seen = Counter(dict(self.seen.most_common(self.most)))

    def batch(self) -> pa.RecordBatch:
        found = sorted(self.seen.most_common(self.most))
        return pa.record_batch([pa.array([[t for t, _ in found]], pa.list_(pa.string())), pa.array([[n for _, n in found]], pa.list_(pa.int64()))], names=["t", "n"])


_SUMMARY = "t array<string>, n array<long>"


def frequent_lengths(docs: DataFrame, text_col: str, path: str, most: int = FREQUENT) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of all texts.

    Each task counts its own and gives one bounded summary; summaries are merged
    FAN at a time until the driver can take the rest.  No pre-token is a shuffle
    key, and none but those in summaries moves.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    for _, tokens in encoder(path).blocks(text or ""):
                        own.add(t for t in tokens or () if len(t) <= 64)
        if own.seen:
            yield own.batch()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(most)
        for batch in batches:
            for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.add(dict(zip(tokens, counts)))
        if own.seen:
            yield own.batch()

    summaries = stored(docs.select(text_col).mapInArrow(counted, _SUMMARY), "summaries")
    parts = summaries.count()
    while parts > FAN:
        parts = -(-parts // FAN)
        summaries = stored(summaries.repartition(parts).mapInArrow(merged, _SUMMARY), "summaries")
    total = Summary(most)
    for tokens, counts in summaries.collect():
        total.add(dict(zip(tokens, counts)))
    tokens = [t for t, _ in sorted(total.seen.items(), key=lambda x: (-x[1], x[0]))[:most]]
    library = encoder(path)
    return {t: len(library._ids(t)) for t in tokens if "\0" not in t}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """One row (id, n_bytes, n_tokens) per row of ``docs``.

    A hash table of the lengths of the corpus's frequent pre-tokens is broadcast
    (at most FREQUENT entries); what it lacks is encoded once per worker and
    remembered in a bounded memo.  No pre-token is shuffled.  Null and empty texts count 0; ids may
    be null or repeated; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary(name)
    lengths = frequent_lengths(docs, text_col, path)
    shipped = docs.sparkSession.sparkContext.broadcast(("\x00".join(lengths), bytes(min(n, 255) for n in lengths.values())))

    key = uuid.uuid4().hex

    def counter() -> PretokenCounter:
        tokens, sizes = shipped.value
        return PretokenCounter(path, {t: n for t, n in zip(tokens.split("\x00"), sizes) if n < 255} if tokens else {})

    def counts(texts: pa.Array) -> pa.Array:
        count = worker_state(key, counter).count
        return pa.array([count(t) for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()], pa.int64())

    return docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.arrow_udf(counts, "long")(F.col(text_col)).alias("n_tokens"))
