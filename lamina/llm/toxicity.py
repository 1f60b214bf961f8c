"""Toxic passages by maximum-scoring segments.

Terms are lower-cased words and their prefixes.  Over all labelled training
texts (each distinct text once) the number of toxic and of other texts with a
term gives its log-odds ratio under an informative Dirichlet prior, and terms
with a positive ratio that a likelihood-ratio test finds significant form the
lexicon: the test looks at the counts alone, so a term that no harmless text
has needs as many toxic texts in a small table as in a large one.  No ratio is
above that of the counts with half a text added to each, so that a term of few
texts weighs little.  A word scores the highest
ratio of its terms in the lexicon, any other word a small loss.  One linear
scan (Ruzzo and Tompa's) finds all maximal scoring segments of a whole text.
Scores of such segments in harmless text follow an extreme-value law: with
lambda solving E[exp(lambda s)] = 1 for the word scores of harmless training
texts, a segment of score S in n words is expected n exp(-lambda S) times by
chance.  A text's evidence adds up the excess of its significant segments, and
a logistic curve, fitted on a bounded sample, turns it into a probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fold, fresh, materialize, small_side, texts_of

#: Lengths in bytes of the prefixes that are terms of their own.
PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
#: Weight of the Dirichlet prior in texts, least z of a term, least toxic texts that have it.
PRIOR, LEAST_Z, LEAST_TEXTS = 20.0, 3.5, 2
#: Least log-odds ratio of a term.
LEAST_RATIO = 2.0
#: A word outside the lexicon scores -LOSS; no word scores over TOP.
LOSS, TOP = 0.25, 8.0
#: A word that came up no more than so many words before scores nothing more: repetition is not evidence.
NEAR = 64
#: Expected chance segments per text below which a segment is significant.
SIGNIFICANT = 0.05
#: Weight of a toxic text against a harmless one in the logistic fit, at most.
RARE = 2.0
#: Labelled texts that the logistic curve may be fitted on.
SAMPLE = 20_000
#: Bits of the table by which counting leaves out terms that no toxic text has.
SLOTS = 1 << 22
#: Terms that a task holds before it passes counts on; words whose score a worker remembers.
HELD = 200_000

_signs = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters and non-ASCII bytes."""
    return data.translate(_signs).split()


def terms_of(word: bytes) -> list[bytes]:
    """A word, marked as whole, and its prefixes."""
    return [b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    lexicon: dict[bytes, float]
    rate: float
    slope: float
    offset: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


class Scorer(dict):
    """Word scores under a lexicon, remembered up to a bound."""

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= HELD:
            self.clear()
        value = max((self.lexicon.get(term, -LOSS) for term in terms_of(word)), default=-LOSS)
        self[word] = value
        return value


def word_scores(words: list[bytes], scorer: Scorer) -> np.ndarray:
    """Scores of a text's words; near repeats of a scoring word count as words outside the lexicon."""
    scores = np.fromiter(map(scorer.__getitem__, words), np.float64, len(words))
    last: dict[bytes, int] = {}
    for at in np.flatnonzero(scores > 0).tolist():
        word = words[at]
        if at - last.get(word, -NEAR - 1) <= NEAR:
            scores[at] = -LOSS
        last[word] = at
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; runs of losses are stepped over at once."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = at, at + 1, total[at], total[at + 1]
        while True:
            back = len(stack) - 1
            while back >= 0 and stack[back][2] >= low:
                back = stack[back][4]
            if back < 0 or stack[back][3] >= high:
                stack.append([start, end, low, high, back])
                break
            start, low = stack[back][0], stack[back][2]
            del stack[back:]
    return [(start, end, high - low) for start, end, low, high, _ in stack]


def evidence(scores: np.ndarray, rate: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Excess of the significant segments over chance, else that of the best segment; and the significant ones."""
    if not len(scores):
        return -1.0, []
    found = segments(scores)
    if not found:
        return -1.0 - math.log(len(scores)), []
    chance = math.log(len(scores))
    excess = [rate * score - chance for _, _, score in found]
    passed = [at for at, x in enumerate(excess) if x > -math.log(SIGNIFICANT)]
    if not passed:
        return max(excess), []
    return sum(excess[at] for at in passed), [found[at] for at in passed]


def labelled(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """id, toxic: one training row for each distinct labelled text outside the held-out fold.

    An id with several labels is toxic if any label says so; of texts that agree the smallest id stands.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    rows = texts.join(small_side(known), "doc_id").where(fold("doc_id", parts) != 0)
    return rows.groupBy("h", "n").agg(F.min(F.struct("doc_id", "toxic")).alias("r")).select(F.col("r.doc_id").alias("id"), (F.col("r.toxic") > 0).alias("toxic"))


def _counter(wanted: np.ndarray | None):
    """A task's count of texts that have a term, of words and of texts; with `wanted`, only of terms in these slots."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        known = _Terms(wanted)
        for part in parts:
            for text in texts_of(part.column(0)):
                words = words_of(text)
                held.update({term for word in set(words) for term in known[word]})
                held[b""] += len(words)
                held[b"#"] += 1
                if len(held) > HELD:
                    yield _rows(held)
        yield _rows(held)

    return count


class _Terms(dict):
    """Terms of words, remembered up to a bound."""

    def __init__(self, wanted: np.ndarray | None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) >= HELD:
            self.clear()
        terms = terms_of(word)
        if self.wanted is not None:
            terms = [term for term in terms if self.wanted[zlib.crc32(term) % SLOTS]]
        self[word] = terms
        return terms


def _rows(held: Counter) -> pa.RecordBatch:
    out = pa.RecordBatch.from_pydict({"term": pa.array([*held], pa.binary()), "texts": pa.array([*held.values()], pa.int64())})
    held.clear()
    return out


def _counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """term, others, toxic: texts of either kind that have a term which several toxic texts have.

    The terms of the toxic texts are counted first; they set bits in a table of fixed size, by which the
    pass over all other texts leaves out what cannot enter the lexicon.  Terms b"" and b"#" hold the
    numbers of words and of texts.
    """
    schema = "term binary, texts long"
    text = docs.select("doc_id", "text").where("text is not null")
    of = lambda toxic: text.join(small_side(known.where(F.col("toxic") == toxic)), F.col("doc_id") == F.col("id")).select("text")
    sums = lambda rows, wanted: rows.mapInArrow(_counter(wanted), schema).groupBy("term").agg(F.sum("texts").alias("texts"))
    toxic = materialize(sums(of(True), None).where(F.col("texts") >= LEAST_TEXTS), "toxic-terms")
    wanted = np.zeros(SLOTS, bool)
    wanted[toxic.select((F.crc32("term") % SLOTS).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    others = sums(of(False), wanted)
    return materialize(toxic.withColumnRenamed("texts", "toxic").join(others.withColumnRenamed("texts", "others"), "term", "left").na.fill(0, ["others"]), "toxic-counts")


def _rate(lexicon: dict[bytes, float], share: dict[bytes, float]) -> float:
    """lambda: sum of p exp(lambda s) = 1 over the word scores of harmless texts."""
    s, p = np.array([*lexicon.values()]), np.array([share[t] for t in lexicon])
    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        total = (1 - min(p.sum(), 0.5)) * math.exp(-LOSS * mid) + (p * np.exp(np.minimum(mid * s, 600.0))).sum()
        low, high = (mid, high) if total < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge-damped logistic fit of y on x by Newton steps; the rarer class weighs RARE times as much at most."""
    rare = min(RARE, max((~y).sum(), 1) / max(y.sum(), 1))
    weight = np.where(y, rare, 1.0)
    scale = max(float(np.abs(x).max()), 1.0)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        margin = a @ w
        return float((weight * (np.logaddexp(0, margin) - y * margin)).sum() + 0.01 * (w @ w))

    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + 0.02 * w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.02 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0] / scale), float(w[1])


def _significance(n0: int, n1: int) -> Column:
    """z of a term's counts (others of n0, toxic of n1): root of the likelihood-ratio statistic of the two by two table."""
    part = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    toxic, others = F.col("toxic"), F.col("others")
    both, n = toxic + others, n0 + n1
    whole = n * math.log(n) - n0 * math.log(n0) - n1 * math.log(n1)
    fit_ = part(toxic) + part(others) + part(n1 - toxic) + part(n0 - others) - part(both) - part(n - both)
    return F.sqrt(F.greatest(2 * (fit_ + whole), F.lit(0.0)))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5) -> Model:
    """Learns from the labels outside the held-out fold; counts cover all of them, the curve at most SAMPLE.

    Without a toxic and a harmless training text every text scores below 0.5.
    """
    spark = docs.sparkSession
    known = materialize(labelled(docs, labels, parts), "toxic-known")
    rows = docs.select("doc_id", "text").where("text is not null").join(small_side(known), F.col("doc_id") == F.col("id"))
    kinds = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Model({}, 1.0, 1.0, -10.0)
    counted = _counts(docs, known)
    totals = {bytes(r["term"]): (r["others"], r["toxic"]) for r in counted.where("term in (X'', X'23')").collect()}
    (n0, n1), (w0, _) = totals.get(b"#", (0, 0)), totals.get(b"", (0, 0))
    if not n0 or not n1:
        return Model({}, 1.0, 1.0, -10.0)
    own = PRIOR * (F.col("others") + F.col("toxic")) / (n0 + n1)
    c1, c0 = F.col("toxic") + own, F.col("others") + own
    ratio = F.log(c1 / (n1 + PRIOR - c1)) - F.log(c0 / (n0 + PRIOR - c0))
    half = lambda part, whole: (F.col(part) + 0.5) / (whole - F.col(part) + 0.5)
    ratio = F.least(ratio, F.log(half("toxic", n1) / half("others", n0)))
    z = _significance(n0, n1)
    strong = (
        counted.where(f"term not in (X'', X'23') and toxic >= {LEAST_TEXTS} and others < {n0} and toxic <= {n1}")
        .select("term", "others", ratio.alias("ratio"), z.alias("z"))
        .where(f"z >= {LEAST_Z} and ratio > {LEAST_RATIO}")
        .orderBy(F.desc("z"), "term")
        .toArrow()
        .to_pydict()
    )
    lexicon = {bytes(t): min(TOP, r) for t, r in zip(strong["term"], strong["ratio"], strict=True)}
    share = {bytes(t): (c + 0.01) / max(w0, 1) for t, c in zip(strong["term"], strong["others"], strict=True)}
    if not lexicon:
        return Model({}, 1.0, 1.0, -10.0)
    rate = _rate(lexicon, share)
    shared = spark.sparkContext.broadcast((lexicon, rate))

    def weigh(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value[0])
        for part in parts_:
            yield pa.RecordBatch.from_pydict({"x": pa.array([_evidence(text, scorer, shared.value[1]) for text in texts_of(part.column(0))], pa.float64()), "y": part.column(1)})

    keep = min(1.0, SAMPLE / (n0 + n1))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < keep * (1 << 20)).select("text", "toxic").mapInArrow(weigh, "x double, y boolean").limit(2 * SAMPLE).toArrow().to_pydict()
    x, y = np.array(sample["x"]), np.array(sample["y"], bool)
    if y.all() or not y.any():
        return Model(lexicon, rate, 1.0, math.log(SIGNIFICANT))
    slope, offset = _logistic(np.clip(x, -30, 30), y)
    return Model(lexicon, rate, max(slope, 1e-3), offset)


def _evidence(text: bytes | None, scorer: Scorer, rate: float) -> float:
    words = words_of(text) if text else []
    return evidence(word_scores(words, scorer), rate)[0]


def passages(text: str, model: Model) -> list[tuple[str, float]]:
    """The significant toxic passages of a text, as their words, with their scores."""
    words = words_of(text.encode())
    scorer = Scorer(model.lexicon)
    _, found = evidence(word_scores(words, scorer), model.rate)
    return [(b" ".join(words[start:end]).decode("utf-8", "replace"), score) for start, end, score in found]


def toxic_score(docs: DataFrame, model: Model, text: str = "text"):
    """A double column: the probability that a text of `docs` is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def verdict(batches_: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        scorer = Scorer(own.lexicon)
        for texts in batches_:
            yield pa.array(own.score(np.clip(np.array([_evidence(t, scorer, own.rate) for t in texts_of(texts)], np.float64), -30, 30)), pa.float64())

    return verdict(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs` (doc_id, text); labels has doc_id, toxic.

    Null and empty texts score as texts without any evidence; null ids are neither learned from nor held
    out; labels that are null, or of unknown ids, are ignored; repeated rows each get their score; an empty
    table gives no rows.  Texts are read whole.  Other columns of either table are ignored.
    """
    judged = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxic_score(docs, fit(docs, labels)).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, that score below 0.5.

    Null and empty texts are kept; repeated rows are kept or go together; without labels of both kinds all rows
    are kept; an empty table gives no rows.
    """
    name = fresh(docs, "toxic")
    return docs.withColumn(name, toxic_score(docs, fit(docs, labels))).where(F.col(name) < 0.5).drop(name)
