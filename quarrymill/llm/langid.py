"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrymill.llm.texts import ROWS, bound_batches, worker_state

#: n-grams of 1 to ORDER characters, hashed to 2**BUCKET_BITS buckets.
ORDER, BUCKET_BITS = 3, 16
#: At most so many labelled rows are learned from: those of least id hash.
TRAIN_ROWS = 8192
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of short texts that are scored together, and of a long text's part.
TOGETHER, CHUNK = 1 << 16, 1 << 20
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SPACE = np.uint32(32)

_letters = np.zeros(0, bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalpha() for c in range(0x33000)])
    return _letters[np.minimum(codes, 0x32FFF)]


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that begin at each position but the last ORDER-1; one array per order."""
    n = len(codes) - ORDER + 1
    shift, out, mixed = np.uint32(32 - BUCKET_BITS), [], np.zeros(n, np.uint32)
    for k in range(ORDER):
        mixed = (mixed ^ codes[k : k + n]) * _MIX[k]
        out.append(((mixed ^ (mixed >> np.uint32(15))) * _MIX[1] >> shift).astype(np.int32))
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with every non-letter a space, one space before and ORDER after each; starts; whether each has a letter."""
    lowered = [f" {t.lower()}{' ' * ORDER}" for t in texts]
    joined = "".join(lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _is_letter(codes)
    codes[~letter] = _SPACE
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes) - sizes
    return codes, starts, np.logical_or.reduceat(letter, starts)


def _parts(text: str) -> Iterator[tuple[list[np.ndarray], bool]]:
    """(n-gram buckets, whether there is a letter) of a text in parts that each see the characters after them."""
    for at in range(-1, len(text), CHUNK):
        part = text[max(at, 0) : at + CHUNK + ORDER - 1].lower()
        end = at + CHUNK + ORDER - 1 > len(text)
        codes = np.frombuffer((" " * (at < 0) + part + " " * ORDER * end).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        letter = _is_letter(codes)
        codes[~letter] = _SPACE
        use = codes != _SPACE
        use[:-1] |= codes[1:] != _SPACE
        own = use[: len(codes) - ORDER + 1]
        yield [g[own] for g in _grams(codes)], bool(letter.any())


@dataclass
class Model:
    """Languages, log priors, and log chances: one row of ``table`` per bucket."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, starts, letters = _codes(texts)
        # a position in a run of spaces says nothing
        use = codes != _SPACE
        use[:-1] |= codes[1:] != _SPACE
        at = np.flatnonzero(use[: len(codes) - ORDER + 1])
        bounds = np.searchsorted(at, starts)
        total = np.zeros((len(texts), len(self.languages)))
        grams = _grams(codes)
        for k in range(0, len(at), CHUNK):
            own = at[k : k + CHUNK]
            summed = sum(self.table[g[own]] for g in grams)
            first = np.searchsorted(bounds, k, "right") - 1
            stop = np.searchsorted(bounds, k + len(own), "left")
            cuts = np.maximum(bounds[first:stop] - k, 0)
            full = np.append(np.cumsum(summed, axis=0, dtype=np.float64), [np.zeros(len(self.languages))], axis=0)
            ends = np.append(cuts[1:], len(own)) - 1
            total[first:stop] += full[ends] - full[cuts - 1]
        return total, letters

    def _long_sums(self, text: str) -> tuple[np.ndarray, bool]:
        """The sums of one long text, part by part."""
        total, letters = np.zeros(len(self.languages)), False
        for grams, found in _parts(text):
            total += sum(self.table[g].sum(axis=0, dtype=np.float64) for g in grams)
            letters |= found
        return total, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its posterior for each text; UNKNOWN and 0 for texts without letters."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums, letters = self._sums([t if len(t) <= CHUNK else "" for t in texts])
        for k, t in enumerate(texts):
            if len(t) > CHUNK:
                sums[k], letters[k] = self._long_sums(t)
        sums += self.prior
        best = sums.argmax(axis=1)
        chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, letters)], [float(c) if x else 0.0 for c, x in zip(chance, letters)]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """Counts n-grams of at most ``most`` labelled rows outside the held-out fold.

    Rows are taken by the hash of their id; of rows that repeat an id the one of
    least hash of language and text is taken.  Tasks count in parallel, their
    sparse vectors are added in Spark, and the driver gets one per language.
    """
    bound_batches(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = usable.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    one = usable.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("lang", "text"), "lang")).alias("r"))
    rows = one.select("r.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    into = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    for grams, _ in _parts(text):
                        for g in grams:
                            into += np.bincount(g, minlength=1 << BUCKET_BITS)
                    seen[lang] = seen.get(lang, 0) + 1
        for lang, vector in counts.items():
            at = np.flatnonzero(vector)
            yield pa.record_batch([pa.array([lang]), pa.array([seen[lang]], pa.int64()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([vector[at].astype("<i8").tobytes()], pa.binary())], names=["lang", "n", "at", "counts"])

    def added(parts: pa.Table) -> pa.Table:
        into = np.zeros(1 << BUCKET_BITS, np.int64)
        for at, counts in zip(parts["at"].to_pylist(), parts["counts"].to_pylist()):
            into[np.frombuffer(at, "<i4")] += np.frombuffer(counts, "<i8")
        at = np.flatnonzero(into)
        return pa.table({"lang": parts["lang"].slice(0, 1), "n": pa.array([sum(parts["n"].to_pylist())], pa.int64()), "at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "counts": pa.array([into[at].astype("<i8").tobytes()], pa.binary())})

    total: dict[str, np.ndarray] = {}
    docs_of: dict[str, int] = {}
    kind = "lang string, n long, at binary, counts binary"
    for r in rows.mapInArrow(counted, kind).groupBy("lang").applyInArrow(added, kind).collect():
        total[r["lang"]] = np.zeros(1 << BUCKET_BITS)
        total[r["lang"]][np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["counts"], "<i8")
        docs_of[r["lang"]] = r["n"]
    languages = sorted(total)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1 << BUCKET_BITS, 0), np.float32))
    matrix = np.stack([total[x] + SMOOTHING for x in languages], axis=1)
    prior = np.log(np.array([docs_of[x] for x in languages]) / sum(docs_of.values()))
    return Model(languages, prior, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def predictor(docs: DataFrame, model: Model):
    """Column function text -> struct(lang_pred, score) with the matrix broadcast."""
    bound_batches(docs.sparkSession)
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def predictions(texts: pa.Array) -> pa.Array:
        model = worker_state(key, lambda: shipped.value)
        langs, scores = [], []
        held: list[str] = []

        def flush() -> None:
            a, b = model.predict(held)
            langs.extend(a)
            scores.extend(b)
            held.clear()

        for at in range(0, len(texts), ROWS):
            size = 0
            for t in texts.slice(at, ROWS).to_pylist():
                held.append(t or "")
                size += len(held[-1])
                if size > TOGETHER:
                    flush()
                    size = 0
            flush()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predictions, "struct<lang_pred:string,score:double>")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row (id, held_out, lang_pred, score) per row of ``docs``.

    The score is the posterior of the predicted language.  Null texts and texts
    without a letter are ``und`` with score 0, as all are if nothing can be
    learned.  Null ids are held out; repeated rows stay repeated.
    """
    of = predictor(docs, train(docs, id_col, text_col, lang_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), of(F.col(text_col)).alias("_p")).select(id_col, "held_out", "_p.lang_pred", "_p.score")


def lettered(texts: pa.Array) -> pa.Array:
    """Whether each text has a letter; null has none."""
    parts = (texts.slice(at, ROWS).to_pylist() for at in range(0, len(texts), ROWS))
    return pa.array([any(map(str.isalpha, t or "")) for part in parts for t in part], pa.bool_())


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Collection[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a wanted language, with all their columns.

    Rejected are null and letterless texts, texts whose predicted language isn't
    among ``languages`` (None: all that were learned) and those whose posterior
    is under ``least``.  If nothing can be learned, no language is known, and
    the letters alone decide.  Repeated rows and null ids are judged as others.
    """
    model = train(docs, id_col, text_col, lang_col)
    if not model.languages:
        return docs.where(F.arrow_udf(lettered, "boolean")(F.col(text_col)))
    found = predictor(docs, model)(F.col(text_col))
    judged = docs.withColumn("__found", found)
    keep = (F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") >= least)
    if languages is not None:
        keep &= F.col("__found.lang_pred").isin(list(languages))
    return judged.where(keep).drop("__found")
