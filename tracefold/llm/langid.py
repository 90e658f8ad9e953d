"""Language ID with a string kernel.

A text is the set of its byte n-grams of lengths 1 to 3 (A-Z lower-cased, other
ASCII that is not a letter read as a blank), hashed to ``SLOTS`` slots: a
blended-spectrum presence kernel ``|x & y| / sqrt(|x| |y|)``.  Kernel ridge
regression, one language against the rest, is solved in the Nystroem space of
``LANDMARKS`` training texts.  Texts are scored in batches: a 0/1 matrix times
the landmarks' matrix, times the coefficients.

The classifier is fitted on at most ``SAMPLE`` labelled rows, the first by a
hash of doc_id, one for each doc_id and language and as many from each language
(one at least); their presence bits (2 KB each) are all that comes to the driver.  Every
text is read whole, in slices if it is long, and scored.

Defined cases: null text or text without a letter gives ``und`` with score 0;
rows with null doc_id count as held out; null lang is never learned; with no
labelled row at all, every text is ``und``; of languages with the same score the
first by name is predicted; texts with the same content, repeated rows among
them, get the same result; an empty table gives no rows; other columns are
ignored or passed through, but for columns named lang_pred or score, which give
way (put the row into a struct column to keep them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .store import small_batches, table

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
SAMPLE = 4096
PARTS = 64
LANDMARKS = 64
RIDGE = 1e-2
GRAMS = (1, 2, 3)
UNDETERMINED = "und"
_FOLDS = 5
_ROWS = 128


def _letters() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


LETTERS = _letters()


def _mark(flags: np.ndarray, raw: np.ndarray, owner: np.ndarray) -> None:
    """Set the slots of all n-grams of the concatenated texts; owner: the text of each byte."""
    code = np.zeros(len(raw), np.uint32)
    row = owner.astype(np.int32) << SLOT_BITS
    out = flags.reshape(-1)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        if n in GRAMS:
            slot = ((code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)
            at = row[: len(slot)] + slot
            out[at[owner[: len(slot)] == owner[n - 1 :]] if n > 1 else at] = 1


def presence(column: pa.Array) -> Iterator[np.ndarray]:
    """0/1 matrices (texts by slots) of at most _ROWS texts each, in order."""
    offsets, data = flat.string_buffer(column)
    n = len(offsets) - 1
    for lo in range(0, n, _ROWS):
        hi = min(lo + _ROWS, n)
        flags = np.zeros((hi - lo, SLOTS), np.uint8)
        doc = lo
        while doc < hi:
            to = min(hi, max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + flat.SLICE, "right")) - 1))
            if to == doc + 1:  # one text, in slices that overlap by what an n-gram needs
                a, end = int(offsets[doc]), int(offsets[to])
                while a < end:
                    b = min(a + flat.SLICE, end)
                    raw = LETTERS[data[a : min(b + max(GRAMS) - 1, end)]]
                    _mark(flags[doc - lo : doc - lo + 1], raw, np.zeros(len(raw), np.int32))
                    a = b
            else:
                raw = LETTERS[data[offsets[doc] : offsets[to]]]
                _mark(flags, raw, np.repeat(np.arange(doc - lo, to - lo, dtype=np.int32), np.diff(offsets[doc : to + 1])))
            doc = to
        yield flags


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % _FOLDS == 0, F.lit(True))


class Model:
    """Landmark bits and the coefficients of each language."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights
        self._marks: np.ndarray | None = None

    def __getstate__(self):
        return {"langs": self.langs, "landmarks": self.landmarks, "weights": self.weights, "_marks": None}

    def kernel(self, flags: np.ndarray) -> np.ndarray:
        if self._marks is None:
            bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._marks = (bits / np.sqrt(bits.sum(1, keepdims=True) + 1e-9)).T.copy()
        x = flags.astype(np.float32)
        return (x @ self._marks) / np.sqrt(x.sum(1, keepdims=True) + 1e-9)

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return self.kernel(flags) @ self.weights


def _sample(docs: DataFrame) -> list:
    """(lang, bits) of at most SAMPLE rows of the training folds."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    # of rows that share a doc_id and a language one is learned from
    rows = usable.groupBy("doc_id", "lang").agg(F.min(F.xxhash64("text")).alias("h"))
    n = rows.select("lang").distinct().count()
    if not n:
        return []
    each = max(1, SAMPLE // n)
    order = F.md5(F.col("doc_id").cast("string"))
    # first within PARTS parts of a language, so the last ranking of one has at most PARTS * SAMPLE rows whatever the input
    rows = rows.withColumn("_o", order).withColumn("_part", F.crc32(F.col("_o").cast("binary")) % PARTS)
    for keys in (["lang", "_part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "doc_id"))
        rows = rows.withColumn("_r", rank).filter(F.col("_r") <= each)
    chosen = rows.select("doc_id", "lang", "h", F.col("_r").alias("r"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [row.tobytes() for flags in presence(b.column(2)) for row in np.packbits(flags, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(bits, pa.binary())], ["doc_id", "lang", "r", "bits"])

    # at most SAMPLE ids, as many as languages at least: this side is bounded
    texts = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["doc_id", "lang", "h"]).select("doc_id", "lang", "text", "r")
    # a row that repeats is one row here, however often it does
    got = texts.mapInArrow(pack, "doc_id bigint, lang string, r int, bits binary").groupBy("doc_id", "lang").agg(F.first("r").alias("r"), F.first("bits").alias("bits")).collect()
    return sorted(got, key=lambda x: (x["r"], x["lang"], x["doc_id"], bytes(x["bits"])))


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and lang of the rows that are not held out."""
    small_batches(docs.sparkSession)
    rows = _sample(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text"))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1)
    model = Model(langs, bits[: min(LANDMARKS, len(rows))].copy(), np.zeros((0, 0)))
    k = np.concatenate([model.kernel(np.unpackbits(bits[i : i + _ROWS], axis=1)) for i in range(0, len(rows), _ROWS)]).astype(np.float64)
    y = np.array([[float(r["lang"] == x) for x in langs] for r in rows])
    share = y / y.sum(0) / len(langs) * len(rows)
    weight = share.sum(1, keepdims=True)  # languages count alike
    kmm = k[: len(model.landmarks)]
    a = k.T @ (k * weight) + RIDGE * len(rows) * 1e-2 * kmm + 1e-6 * np.eye(len(kmm))
    model.weights = np.linalg.solve(a, k.T @ (y * weight)).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, inside: str | None = None) -> DataFrame:
    """The ``keep`` columns of every row (all, if not given) with lang_pred and score; only ``text`` is looked at to predict.

    ``inside`` names a struct column of ``keep`` that holds the text, which then goes to Python once, not twice.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            letter = b.column(0).to_pylist()
            langs, scores = [UNDETERMINED] * len(letter), [0.0] * len(letter)
            if m is not None:
                at = 0
                for flags in presence(b.column(1) if inside is None else b.column(1 + keep.index(inside)).field("text")):
                    s = m.scores(flags)
                    best = s.argmax(1)
                    for i, (j, v) in enumerate(zip(best.tolist(), s[np.arange(len(s)), best].tolist(), strict=True)):
                        if letter[at + i]:
                            langs[at + i], scores[at + i] = m.langs[j], min(1.0, max(0.0, v))
                    at += len(flags)
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    text = F.col("text") if inside is None else F.col(inside)["text"]
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    first = 1 if inside else 2
    rows = docs.select(letter.alias("_letter"), *[text.alias("_text")][: first - 1], *keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
