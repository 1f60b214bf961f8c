"""Quality by ordinal regression on graded ratings.

A text's features are hashed: the share of its words that fall on a slot as
words, and as shapes (case, digits, signs, repetition); a few densities have
slots of their own.  One weight vector w serves all grades, and ordered
thresholds t_1 < t_2 < ... cut the line: P(grade <= k) = sigma(t_k - w x).  The
expected grade and the tail probability P(grade >= k) follow from the margin.

A word's part of the margin is a number that a worker remembers, so a whole
text is scored in one pass over its words.  The fit reads a bounded sample of
rated rows, chosen by a hash of the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fold, fresh, texts_of

#: Hashed slots of words and of shapes; densities.
WORD_SLOTS, SHAPE_SLOTS, DENSITIES = 4096, 2048, 6
#: Rated texts that a fit may use.
SAMPLE = 6000
#: Scales of the feature groups; ridge, steps and rate of the fit.
WORD_SCALE, SHAPE_SCALE = 4.0, 8.0
RIDGE, STEPS, STEP = 1e-4, 250, 0.05
#: Words whose slots a worker remembers.
HELD = 400_000

SLOTS = WORD_SLOTS + SHAPE_SLOTS + DENSITIES
_kinds = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_signs = bytes(c for c in range(128) if not chr(c).isalnum())


def shape(word: bytes) -> bytes:
    """Kinds of a word's signs, runs squeezed: b'Word!!' is b'Aa!'."""
    kinds = word.translate(_kinds)
    return bytes(c for at, c in enumerate(kinds) if not at or kinds[at - 1] != c)


def slots(word: bytes) -> tuple[int, int]:
    """The slots of a word as a word and as a shape."""
    return zlib.crc32(word.lower().strip(_signs)) % WORD_SLOTS, WORD_SLOTS + zlib.crc32(shape(word)) % SHAPE_SLOTS


def densities(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of repeated neighbours, of distinct words (long texts discounted), of upper case, signs and digits; length."""
    n = max(len(words), 1)
    same = sum(map(bytes.__eq__, words[1:], words)) / n
    letters = text.translate(_kinds)
    size = max(len(text), 1)
    return [same, min(1.0, len(set(words)) / n**0.8), letters.count(b"A") / size, 1 - (letters.count(b"A") + letters.count(b"a") + letters.count(b"0") + letters.count(b" ")) / size, letters.count(b"0") / size, np.log1p(n) / 10]


class Slots(dict):
    """Slots of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= HELD:
            self.clear()
        self[word] = found = slots(word)
        return found


def features(text: bytes, known: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero slots and their values."""
    words = text.split()
    at = np.fromiter((x for word in words for x in known[word]), np.int64, 2 * len(words))
    where, count = np.unique(at, return_counts=True)
    value = count / max(len(words), 1) * np.where(where < WORD_SLOTS, WORD_SCALE, SHAPE_SCALE)
    return np.concatenate([where, np.arange(SLOTS - DENSITIES, SLOTS)]), np.concatenate([value, densities(text, words)])


@dataclass(frozen=True)
class Model:
    """Weights, ordered thresholds, and the grades they separate."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def expected(self, margin: np.ndarray) -> np.ndarray:
        tails = self.tails(margin)
        return self.grades[0] + (tails * np.diff(self.grades)).sum(axis=1) if len(self.grades) > 1 else np.full(len(margin), float(self.grades[0]))

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k-th) for all grades but the highest, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -30, 30)))


class Margin(dict):
    """Each word's part of the margin, times the text's number of words."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= HELD:
            self.clear()
        as_word, as_shape = slots(word)
        self[word] = value = float(WORD_SCALE * self.weights[as_word] + SHAPE_SCALE * self.weights[as_shape])
        return value

    def of(self, text: bytes | None) -> float:
        text = text or b""
        words = text.split()
        own = sum(map(self.__getitem__, words)) / max(len(words), 1)
        return own + float(np.dot(self.weights[SLOTS - DENSITIES :], densities(text, words)))


def solve(where: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray) -> Model:
    """Cumulative-link fit by Adam on all rows; thresholds are the first one plus positive gaps."""
    grades = sorted(set(grade.tolist()))
    rank = np.searchsorted(grades, grade)
    row = np.repeat(np.arange(len(where)), [len(x) for x in where])
    at, x = np.concatenate(where), np.concatenate(value)
    cuts = len(grades) - 1
    share = np.cumsum(np.bincount(rank, minlength=len(grades)))[:-1] / len(rank)
    first = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(SLOTS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, power = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        w, gaps = free[:SLOTS], np.exp(np.clip(free[SLOTS + 1 :], -10, 5))
        t = free[SLOTS] + np.concatenate([[0], np.cumsum(gaps)])
        margin = np.bincount(row, w[at] * x, len(where))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = (1 / (1 + np.exp(np.clip(margin - e, -30, 30))) for e in (edge[rank + 1], edge[rank]))
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p  # -d log p / d margin is up - low
        d_margin = (up - low) / len(where)
        slope = np.zeros_like(free)
        slope[:SLOTS] = np.bincount(at, x * d_margin[row], SLOTS) + RIDGE * w
        d_t = (np.bincount(rank, low, cuts + 1)[1:] - np.bincount(rank, up, cuts + 1)[:-1]) / len(where)
        slope[SLOTS] = d_t.sum()
        slope[SLOTS + 1 :] = np.cumsum(d_t[::-1])[::-1][1:] * gaps
        mean, power = 0.9 * mean + 0.1 * slope, 0.99 * power + 0.01 * slope**2
        free = free - STEP * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(np.clip(free[SLOTS + 1 :], -10, 5))
    return Model(free[:SLOTS], free[SLOTS] + np.concatenate([[0], np.cumsum(gaps)]), grades)


def fit(docs: DataFrame, ratings: DataFrame, parts: int = 5) -> Model:
    """Learns from rated rows outside the held-out fold, at most SAMPLE; `ratings` has doc_id and grade.

    An id with several grades has the lowest one.  Without any rating every text has grade 0; with one
    grade only, that grade.
    """
    known = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).where(fold("doc_id", parts) != 0)
    total = known.count()
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, SAMPLE / max(total, 1)) * (1 << 20)).limit(2 * SAMPLE)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")

    def weigh(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_ = Slots()
        for part in parts_:
            found = [features(text, slots_) for text in texts_of(part.column(0))]
            yield pa.RecordBatch.from_pydict(
                {"where": pa.array([w.astype(np.uint16).tobytes() for w, _ in found], pa.binary()), "value": pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()), "grade": part.column(1).cast(pa.int32()), "id": part.column(2)}
            )

    got = rows.select("text", "grade", F.col("doc_id").cast("long")).mapInArrow(weigh, "where binary, value binary, grade int, id long").limit(2 * SAMPLE).toArrow().sort_by("id").to_pydict()
    grades = np.array(got["grade"], np.int64)
    if len(set(got["grade"])) < 2:
        return Model(np.zeros(SLOTS), np.zeros(0), [int(grades[0])] if len(grades) else [0])
    return solve([np.frombuffer(w, np.uint16).astype(np.int64) for w in got["where"]], [np.frombuffer(v, np.float32).astype(float) for v in got["value"]], grades)


def graded(docs: DataFrame, model: Model, level: int, text: str = "text") -> Column:
    """A struct column (expected, tail): the expected grade and P(grade >= level)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected: double, tail: double>")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        margin = Margin(own.weights)
        for texts in batches:
            m = np.array([margin.of(x) for x in texts_of(texts)], float)
            below = [k for k, grade in enumerate(own.grades[:-1]) if own.grades[k + 1] >= level > grade]
            tail = own.tails(m)[:, below[0]] if below else np.full(len(m), float(own.grades[0] >= level))
            yield pa.StructArray.from_arrays([pa.array(own.expected(m), pa.float64()), pa.array(tail, pa.float64())], ["expected", "tail"])

    return verdict(F.col(text))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 low quality, 1 good but toxic, 2 good; a null toxic counts as harmless."""
    good = F.col("quality") > 0
    return labels.select("doc_id", F.when(~good, 0).when(good & (F.coalesce("toxic", F.lit(0)) > 0), 1).when(good, 2).alias("grade"))


def rate_quality(docs: DataFrame, ratings: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, held_out, expected_grade, tail, selected: one row per row of `docs` (doc_id, text).

    tail is P(grade >= level), selected whether it is at least 0.5.  Null and empty texts are graded as texts
    without words; null ids are neither learned from nor held out; null ratings are ignored; repeated rows
    are graded each; an empty table gives no rows.  Texts are read whole.  Other columns are ignored.
    """
    judged = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), graded(docs, fit(docs, ratings), level).alias("v"))
    return judged.select("doc_id", "held_out", F.col("v.expected").alias("expected_grade"), F.col("v.tail").alias("tail"), (F.col("v.tail") >= 0.5).cast("int").alias("selected"))


def keep_good(docs: DataFrame, ratings: DataFrame, level: int = 1) -> DataFrame:
    """The rows of `docs`, unchanged, whose tail probability is at least 0.5.

    Null and empty texts are graded as texts without words; repeated rows are kept or go together; without ratings
    every text has grade 0; an empty table gives no rows.
    """
    name = fresh(docs, "grade")
    return docs.withColumn(name, graded(docs, fit(docs, ratings), level)).where(F.col(name)["tail"] >= 0.5).drop(name)
