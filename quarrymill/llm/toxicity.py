"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrymill.llm.texts import ROWS, bound_batches, give_back, raw_texts, word_blocks, worker_state
from quarrymill.plans.storage import stored

#: Width of the feature space in bits; feature 0 is the bias.
FEATURE_BITS = 20
#: At most so many labelled rows, of at most so many bytes of text together, are learned from: those of least id hash.
TRAIN_ROWS, TRAIN_BYTES = 12288, 48 << 20
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: Odd multipliers of the hash mixes of single words, pairs and skip-grams.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(64 - FEATURE_BITS)


def features(text: bytes | None) -> np.ndarray:
    """Sorted different features of a text: its words, word pairs, and pairs over one skipped word.

    Word classes are the byte classes of ``texts.WORD``.  Every text has the bias.
    """
    found, tail = [np.zeros(1, np.int32)], []
    for words in word_blocks((text or b"").lower()):
        fresh = list(map(crc32, words))
        h = np.array(tail + fresh, np.uint64) + np.uint64(1)
        if not len(h):
            continue
        mixed = [h * _MIX[0], h[:-1] * _MIX[1] ^ h[1:] * _MIX[2], h[:-2] * _MIX[2] ^ h[2:] * _MIX[3]]
        hashed = np.concatenate([(m ^ (m >> np.uint64(29))) * _MIX[0] >> _TOP for m in mixed])
        found.append(np.unique(hashed).astype(np.int32))
        tail = (tail + fresh)[-2:]
    return np.unique(np.concatenate(found)) if len(found) > 2 else np.concatenate(found)


@dataclass
class SparseWeights:
    """The features with weights other than zero: what is broadcast."""

    index: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << FEATURE_BITS, np.float32)
        out[self.index] = self.value
        return out


class FTRL:
    """FTRL-proximal (McMahan et al., 2013) for logistic loss and binary features.

    Each coordinate keeps the sum of its gradients less its proximal shifts (z)
    and of their squares (n); its rate falls with n, and L1 holds z below the
    threshold at exactly zero weight.
    """

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << FEATURE_BITS)
        self.n = np.zeros(1 << FEATURE_BITS)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, own: np.ndarray, label: int) -> None:
        z, n = self.z[own], self.n[own]
        w = self._weights(z, n)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[own] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[own] = n + g * g

    def weights(self) -> SparseWeights:
        w = self._weights(self.z, self.n)
        index = np.flatnonzero(w)
        return SparseWeights(index.astype(np.int32), w[index].astype(np.float32))


def fit(rows: Sequence[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> SparseWeights:
    """Learns from (features, label) rows, in the given order in each epoch."""
    model = FTRL()
    for _ in range(epochs):
        for own, label in rows:
            model.learn(own, label)
    return model.weights()


def score(text: bytes | None, dense: np.ndarray) -> float:
    margin = float(dense[features(text)].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def _feature_bytes(texts: pa.Array) -> pa.Array:
    """Compressed steps between a text's features."""
    return pa.array([zlib.compress(np.diff(features(t), prepend=0).astype("<i4").tobytes(), 1) for t in raw_texts(texts)], pa.binary())


def _features_of(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> SparseWeights:
    """Weights from at most ``most`` labelled rows outside the held-out fold.

    Rows are taken by the hash of their id, while their texts have at most
    ``most_bytes`` together; a document with several labels counts as toxic if
    any says so, and of rows that repeat an id the text of least hash is taken.
    Texts become features in parallel; one task, whose memory the two bounds
    limit, learns from them in the order of the hash, and the driver gets the
    weights.  Without labelled rows all weights are zero.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    one = usable.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = F.broadcast(one.orderBy(F.xxhash64(id_col), id_col).limit(most))
    sized = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_n")).join(chosen, id_col).groupBy(id_col, "_label").agg(F.max("_n").alias("_n"))
    sums = sized.withColumn("_sum", F.sum("_n").over(W.orderBy(F.xxhash64(id_col), id_col)))
    within = stored(sums.where(F.col("_sum") <= most_bytes).select(id_col, "_label"), "training-ids")
    texts = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(within), id_col).groupBy(id_col, "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = texts.select(F.xxhash64(id_col).alias("h"), F.col(id_col).cast("string").alias("i"), "_label", F.arrow_udf(_feature_bytes, "binary")("_text").alias("f"))
    ordered = rows.repartition(1).sortWithinPartitions("h", "i").select("_label", "f")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, labels = [], [], []
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                own, packed = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                found = [_features_of(f) for f in packed]
                sizes += map(len, found)
                labels += (int(y > 0) for y in own)
                held.append(np.concatenate(found))
        # one block for all rows' features, so that it goes back to the system as a whole
        joined = np.concatenate(held) if held else np.zeros(0, np.int32)
        held.clear()
        ends = np.cumsum(sizes).tolist()
        w = fit([(joined[e - n : e], y) for n, e, y in zip(sizes, ends, labels)])
        del joined
        give_back()
        yield pa.record_batch([pa.array([w.index.astype("<i4").tobytes()], pa.binary()), pa.array([w.value.astype("<f4").tobytes()], pa.binary())], names=["index", "value"])

    found = ordered.mapInArrow(learned, "index binary, value binary").collect()
    if not found:
        return SparseWeights(np.zeros(0, np.int32), np.zeros(0, np.float32))
    return SparseWeights(np.frombuffer(found[0]["index"], "<i4"), np.frombuffer(found[0]["value"], "<f4"))


def scorer(docs: DataFrame, weights: SparseWeights):
    """Column function text -> score with the weights broadcast."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def scores(texts: pa.Array) -> pa.Array:
        dense = worker_state(key, lambda: shipped.value.dense())
        return pa.array([score(t, dense) for t in raw_texts(texts)], pa.float64())

    return F.arrow_udf(scores, "double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, held_out, score) per row of ``docs``; the score is the chance of label 1.

    Null and empty texts get the bias's score.  Null ids are held out; repeated
    rows stay repeated.  Other columns are not read.
    """
    of = scorer(docs, train(docs, labels, id_col, text_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), of(F.col(text_col)).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns; all rows if nothing is learned."""
    weights = train(docs, labels, id_col, text_col)
    if not len(weights.index):
        return docs
    return docs.where(scorer(docs, weights)(F.col(text_col)) < 0.5)
