"""URL filter: rules first, boosted trees on lexical features for the rest.

A rule fits its host and all subdomains of it, if the path starts with the
rule's; the longest fitting rule decides.  Every other URL is judged by its
looks alone.  Statistics of host suffixes (how many labelled URLs end in them,
how many are blocked) are counted over all labelled URLs in hashed slots of a
fixed number.  Gradient-boosted regression trees with logistic loss learn from
a bounded sample of the labelled URLs, chosen by hash, whose suffix statistics
come from the other folds of the labelled URLs.  Models fitted on all folds but
one score the fold left out, and the cut between allow and block is where, on
these scores, most more bad than good URLs are blocked, beyond chance; where
looks tell nothing, no cut does so and nothing is blocked.

The labelled URLs of the tables here are those whose path names a labelled
document: such a URL is to be blocked if its document is of low quality or
toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import small_side

#: Host, path prefix, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Slots of the suffix statistics; labelled URLs that the trees may learn from.
SLOTS, SAMPLE, FOLDS = 1 << 15, 20_000, 5
TREES, DEPTH, BINS, RATE, LEAF, L2 = 40, 3, 32, 0.1, 30, 5.0
#: Standard errors by which a cut has to block more bad than good URLs.
SURE = 3.0
#: Weight of the overall rate in a suffix's rate.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; empty for null or without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffixes(host: str) -> tuple[int, int, int]:
    """Slots of the host's last label, last two and last three labels."""
    labels = host.split(".")
    return tuple(zlib.crc32(f"{n}:{'.'.join(labels[-n:])}".encode()) % SLOTS for n in (1, 2, 3))


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    share = np.array([*Counter(text).values()]) / len(text)
    return float(-(share * np.log2(share)).sum())


FEATURES = (
    "url length", "host length", "path length", "labels", "path depth", "digit share", "host digit share", "host hyphens", "entropy", "host entropy",
    "parameters", "fragment", "secure", "longest path part", "file suffix", "rate of 1 label", "rate of 2", "rate of 3", "share of 3",
)


def features(url: str | None, host: str, path: str, blocked: np.ndarray, seen: np.ndarray) -> list[float]:
    """The lexical features under suffix statistics `blocked` and `seen`, one number a slot."""
    url = url or ""
    digits = sum(map(str.isdigit, url))
    query = re.search(r"\?([^#]*)", url)
    parts = path.split("/")
    base = blocked.sum() / max(seen.sum(), 1.0)
    slots = suffixes(host)
    rates = [(blocked[slot] + PRIOR * base) / (seen[slot] + PRIOR) for slot in slots]
    known = float(seen[slots[2]]) / max(seen.sum(), 1.0)
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), digits / max(len(url), 1), sum(map(str.isdigit, host)) / max(len(host), 1), host.count("-"), _entropy(url), _entropy(host),
        len([x for x in re.split("[&;]", query[1]) if x]) if query else 0, "#" in url, url.lower().startswith("https:"), max(map(len, parts)), "." in parts[-1], *rates, known,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in flat arrays: split feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order gradient boosting with logistic loss over histograms of quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = []  # halfway between neighbouring values, at quantiles
    for column in x.T:
        values = np.unique(column)
        at = np.searchsorted(values, np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")))
        at = at[at + 1 < len(values)]
        edges.append((values[at] + values[at + 1]) / 2)
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
    margin = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first = 2**depth - 1
            gain, cut = np.zeros(2**depth), np.full((2**depth, 2), -1, np.int64)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key, size = (node - first) * BINS + binned[:, j], 2**depth * BINS
                sums = [np.bincount(key, w, size).reshape(-1, BINS).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                score = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                score[(nl < LEAF) | (nt - nl < LEAF)] = 0
                best = score.argmax(axis=1)
                better = score[np.arange(len(best)), best] > gain + 1e-9
                gain[better], cut[better] = score[better, best[better]], np.stack([np.full(better.sum(), j), best[better]], axis=1)
            for at in np.flatnonzero(cut[:, 0] >= 0):
                j, b = cut[at]
                feature[first + at], threshold[first + at] = j, edges[j][b] if b < len(edges[j]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(base, *(np.stack(x) for x in zip(*trees, strict=True)))


@dataclass(frozen=True)
class Model:
    """The trees under the suffix statistics; cut and gain (bad less good URLs blocked, a share of all) and area under the curve are out of fold."""

    trees: Trees | None
    blocked: np.ndarray
    seen: np.ndarray
    cut: float = 0.5
    gain: float = 0.0
    area: float = 0.5


def best_cut(score: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(cut, gain, area): URLs that score at least `cut`, halfway between neighbouring scores, are blocked; inf if no cut surely blocks more bad than good ones."""
    order = np.argsort(-score, kind="stable")
    ranked = y[order] > 0
    worth = np.cumsum(np.where(ranked, 1, -1))
    last = np.flatnonzero(np.append(np.diff(score[order]) != 0, True))  # equal scores are cut together
    best = last[worth[last].argmax()]
    places = np.empty(len(y))
    _, first, count = np.unique(score, return_index=True, return_counts=True)
    places[np.argsort(score, kind="stable")] = np.repeat(np.cumsum(count) - (count - 1) / 2, count)
    bad = int(ranked.sum())
    area = (places[y > 0].sum() - bad * (bad + 1) / 2) / (bad * (len(y) - bad))
    if worth[best] < SURE * (best + 1) ** 0.5:
        return float("inf"), 0.0, float(area)
    below = score[order][min(best + 1, len(y) - 1)]
    return float(score[order][best] + below) / 2, float(worth[best]) / len(y), float(area)


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode()) % FOLDS


def _suffix_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, blocked = np.zeros(FOLDS * SLOTS, np.int64), np.zeros(FOLDS * SLOTS, np.int64)
    for part in parts:
        for url, host, label in zip(*(part.column(at).to_pylist() for at in range(3)), strict=True):
            slots = fold_of(url) * SLOTS + np.array(suffixes(host))
            seen[slots] += 1
            blocked[slots] += label
    slots = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"slot": slots, "seen": seen[slots], "blocked": blocked[slots]})


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked: the URLs of `pages` whose path's first number is a document of `labels` (doc_id, quality, toxic).

    A document with several rows is blocked if any row says so; nulls say nothing.
    """
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) < 1) | (F.coalesce("toxic", F.lit(0)) > 0)).alias("blocked"))
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})", 1), F.lit("9" * 18)).cast("long")
    return pages.select(F.col("url").cast("string").alias("url")).where("url is not null").withColumn("doc_id", number).join(small_side(bad), "doc_id").select("url", "blocked")


def fit(known: DataFrame) -> Model:
    """Learns from labelled URLs (url, blocked).

    Without labelled URLs, or with one label only, the model has no trees: it allows all, or gives that label.
    """
    labelled = known.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("label"))
    sums = labelled.select("url", "host", "label").mapInArrow(_suffix_counts, "slot long, seen long, blocked long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")).toArrow()
    by_fold = np.zeros((2, FOLDS * SLOTS))
    by_fold[:, sums.column("slot").to_numpy()] = sums.column("seen").to_numpy(), sums.column("blocked").to_numpy()
    by_fold = by_fold.reshape(2, FOLDS, SLOTS)
    seen, blocked = by_fold.sum(axis=1)
    total = labelled.count()
    if not total:
        return Model(None, blocked, seen)
    rate = min(1.0, SAMPLE / total)
    rows = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < rate * (1 << 20)).limit(2 * SAMPLE).collect()
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(None, blocked, seen)
    order = sorted(range(len(rows)), key=lambda at: (rows[at]["url"] or "", rows[at]["label"]))
    folds = [(blocked - by_fold[1, f], seen - by_fold[0, f]) for f in range(FOLDS)]
    own = np.array([fold_of(rows[at]["url"]) for at in order])
    x = np.array([features(rows[at]["url"], rows[at]["host"], rows[at]["path"], *folds[f]) for at, f in zip(order, own, strict=True)], float)
    y = y[order]
    out_of_fold = np.full(len(y), y.mean())
    for f in range(FOLDS):
        rest = own != f
        if (~rest).any() and 0 < y[rest].sum() < rest.sum():
            out_of_fold[~rest] = 1 / (1 + np.exp(-boost(x[rest], y[rest]).margin(x[~rest])))
    return Model(boost(x, y), blocked, seen, *best_cut(out_of_fold, y))


def judge(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of `pages` (page_id, url); `known` as for `fit`.

    A null URL, or one without "://", has empty host and path, so no rule; the model judges its features.
    score is the model's probability of block (0 or 1 where the labels are of one kind).  Repeated rows are
    judged each; null ids stay null; an empty table gives no rows.  Other columns are ignored.
    """
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("r", rule_of(F.col("host"), F.col("path"))).select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))
    fitted = fit(known)
    model = pages.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("double")
    def score(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        own = model.value
        if own.trees is None:
            return pa.array(np.full(len(urls), float(own.blocked.sum() > 0)))
        if not len(urls):
            return pa.array([], pa.float64())
        x = np.array([features(*row, own.blocked, own.seen) for row in zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist(), strict=True)], float)
        return pa.array(1 / (1 + np.exp(-own.trees.margin(x))))

    scored = ruled.withColumn("score", score("url", "host", "path"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= F.lit(fitted.cut), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
