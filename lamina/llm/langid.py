"""Language identification by string kernels.

The kernel of two texts is the share of character n-grams (orders 1 to ORDER,
blended) that are present in both: with presence vectors s over hashed n-grams
it is <s, t> / (|s| |t|).  Landmark texts span the kernel's Nystroem
approximation, and one kernel ridge regression per language is solved on it.
A batch of texts is scored by two matrix products, presence by landmarks and
landmarks by coefficients; as the kernel is linear in a text's presence vector
up to its norm, the second product is folded into the landmarks once.

Training reads a bounded sample of the labelled rows, chosen by a hash of the
id; scoring reads every whole text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fold, fresh

#: Orders of the blended spectrum, and hashed n-grams.
ORDER, SLOTS = 4, 1 << 14
#: Labelled texts that a fit may use, in all and for each language.
SAMPLE, SAMPLE_EACH = 4000, 600
LANDMARKS, RIDGE = 256, 1e-2
#: Languages that a model may have; a fit fails beyond that.
MOST_LANGUAGES = 1000
#: Sharpness of the softmax that turns regression values into a score.
SHARP = 6.0
#: Texts scored by one matrix product.
BLOCK = 64
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]")
_fold = np.arange(0x590, dtype=np.uint32)
for _c in range(len(_fold)):
    _low = chr(_c).lower()
    _fold[_c] = ord(_low) if len(_low) == 1 and _low.isalpha() else _c if chr(_c).isalpha() or unicodedata.combining(chr(_c)) else 32


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams a text has; letters lower-cased, other signs of the Latin, Greek, Cyrillic and Armenian blocks as one space."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = points < len(_fold)
    points = np.where(low, _fold[np.where(low, points, 0)], points)
    if len(points) > 1:
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    found = np.zeros(SLOTS, bool)
    code = points.astype(np.uint64)
    for order in range(1, ORDER + 1):
        if order > 1:
            if len(points) < order:
                break
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :]
        mixed = (code + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
        found[(mixed >> np.uint64(64 - 14)).astype(np.int64)] = True
    return found


@dataclass(frozen=True)
class Model:
    """languages, and the folded landmarks: SLOTS x languages."""

    languages: list[str]
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [at for at, text in enumerate(texts) if text is not None and _letter.search(text)]
        if not self.languages:
            return names, values
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            spectrum = np.stack([presence(texts[row]) for row in some]).astype(np.float32)
            margin = (spectrum @ self.weights) / np.sqrt(spectrum.sum(axis=1))[:, None]
            odds = np.exp(SHARP * (margin - margin.max(axis=1, keepdims=True)))
            for row, one in zip(some, odds / odds.sum(axis=1, keepdims=True), strict=True):
                names[row], values[row] = self.languages[one.argmax()], float(one.max())
        return names, values


def solve(spectra: np.ndarray, labels: np.ndarray) -> Model:
    """Nystroem kernel ridge regression, one against the rest; landmarks are the first rows of each language in turn, one each at least.

    `spectra` are presence vectors, or their packed bits; they are unpacked in blocks, so that the driver holds few.
    """
    packed = np.packbits(spectra, axis=1) if spectra.shape[1] == SLOTS else spectra

    def unit(rows: np.ndarray) -> np.ndarray:
        own = np.unpackbits(packed[rows], axis=1).astype(np.float32)
        own /= np.sqrt(np.maximum(own.sum(axis=1, keepdims=True), 1))
        return own

    languages = sorted(set(labels.tolist()))
    rank = np.zeros(len(labels), np.int64)
    for language in languages:
        own = np.flatnonzero(labels == language)
        rank[own] = np.arange(len(own))
    chosen = np.lexsort((labels, rank))[: max(LANDMARKS, len(languages))]
    landmarks = unit(chosen)
    blocks = np.array_split(np.arange(len(packed)), -(-len(packed) // (4 * BLOCK)))
    cross, square = np.concatenate([unit(rows) @ landmarks.T for rows in blocks]).astype(np.float64), (landmarks @ landmarks.T).astype(np.float64)
    goal = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    system = cross.T @ cross + RIDGE * len(packed) * square / LANDMARKS + 1e-6 * np.eye(len(chosen))
    return Model(languages, (landmarks.T @ np.linalg.solve(system, cross.T @ goal)).astype(np.float32))


def fit(docs: DataFrame, learn: Column) -> Model:
    """Fits on rows of `docs` where `learn` holds and text and lang are not null: at most SAMPLE_EACH a language.

    Rows are kept by a hash of doc_id against a rate from the language's count, so that the sample is
    the same for any partitioning.  Without any such row every text is `und`; with over MOST_LANGUAGES
    values of lang the fit fails, as no language is left out.
    """
    rows = docs.select(F.col("text"), F.col("lang").alias("label"), F.xxhash64("doc_id", "text").alias("key")).where(learn & F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("label").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not counts:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    each = min(SAMPLE_EACH, max(4, SAMPLE // len(counts)))
    rate = F.create_map(*[F.lit(x) for row in counts for x in (row["label"], min(1.0, 1.5 * each / row["count"]))])

    def spectra(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            packed = [np.packbits(presence(text)).tobytes() for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": part.column(1), "key": part.column(2), "bits": pa.array(packed, pa.binary())})

    picked = rows.where(F.pmod("key", F.lit(1 << 20)) < F.try_element_at(rate, F.col("label")) * (1 << 20))
    got = picked.mapInArrow(spectra, "label string, key long, bits binary").toArrow().sort_by("key").to_pydict()
    labels, bits = np.array(got["label"]), got["bits"]
    keep = np.zeros(len(labels), bool)
    for language in set(got["label"]):
        keep[np.flatnonzero(labels == language)[:each]] = True
    if not keep.any():
        return Model([], np.zeros((SLOTS, 0), np.float32))
    return solve(np.frombuffer(b"".join(bits), np.uint8).reshape(len(labels), SLOTS // 8)[keep], labels[keep])


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang, score) for the texts of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def verdict(texts: pa.Array) -> pa.Array:
        names, values = shared.value.score(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang", "score"])

    return verdict(F.col(text))


def learn_fold(parts: int = 3, remainder: int = 1) -> Column:
    """Rows that may be learned from: crc32 of the id's text modulo `parts` is not `remainder`; not rows with a null id."""
    return F.coalesce(fold("doc_id", parts) != remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of `docs` (doc_id, text, lang).

    A null text, or one without letters, is `und` with score 0; null langs and null ids are not learned
    from; a null id is not held out; repeated rows each get their verdict; an empty table gives no rows.
    Texts are read whole.  Other columns are ignored.
    """
    model = fit(docs, learn_fold())
    judged = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), predict(docs, model).alias("v"))
    return judged.select("doc_id", "held_out", F.col("v.lang").alias("lang_pred"), F.col("v.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a language that scores at least `least`.

    Null texts and texts without letters go; null ids and langs are kept by their text; repeated rows are kept or
    go together; without a learned language nothing is kept; an empty table gives no rows.
    """
    name = fresh(docs, "lang")
    judged = docs.withColumn(name, predict(docs, fit(docs, learn_fold())))
    return judged.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)
