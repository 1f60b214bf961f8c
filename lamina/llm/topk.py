"""Exact top-k by integer inner product over an impact-ordered, score-at-a-time index.

Every component x becomes the integer impact floor(256 x).  A shard's index
has, for each dimension, posting segments: the rows whose impact falls into
one quantised level.  A query visits segments by descending contribution
(its own component times the segment's outermost impact) and adds that bound
to the accumulators of the segment's rows.  Unvisited segments can add at most
R, the sum over dimensions of the next segment's contribution where that is
positive, so accumulator + R bounds every row's score from above.  The visit
ends only on proof: when no row's bound reaches the k-th best exact score, or
when all segments that could raise a bound are done.  Rows whose bound still
reaches the k-th best score are possible members and are rescored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from lamina.llm.vectors import Best, search

#: Impacts are grouped into levels of 2**LEVEL_BITS.
LEVEL_BITS = 4
#: Rows with the highest accumulators that set the first exact threshold.
FIRST = 32
#: The proof is tried after each of so many equal parts of the segments.
PARTS = 4
#: Components that count as they are; bounds up to which whole numbers are exact in float64.
LARGEST, EXACT = float(1 << 54), float(1 << 53)


def impacts(matrix: np.ndarray) -> np.ndarray:
    """floor(256 x) of float64 components; beyond LARGEST either way a component counts as LARGEST."""
    return np.floor(np.clip(matrix, -LARGEST, LARGEST) * 256.0).astype(np.int64)


def scores_of(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exact at any size; beyond 64 bits the nearest long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum(dtype=float))
    if most < EXACT:
        return rows @ query
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in rows.astype(object) @ query.astype(object)], np.int64)


class ImpactIndex:
    """Posting segments of one shard in flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.ids, self.rows, self.posts, self.dim, self.first, self.low, self.high = (arrays[name] for name in ("ids", "rows", "posts", "dim", "first", "low", "high"))
        self.end = np.append(self.first[1:], self.rows.size)
        self.most = float(np.abs(self.rows).max(initial=0))

    @staticmethod
    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, np.ndarray]:
        rows = impacts(matrix)
        n, dims = rows.shape
        levels = rows >> LEVEL_BITS
        posts, dim, first, low, high = [], [], [], [], []
        for j in range(dims):
            order = np.argsort(levels[:, j], kind="stable")
            cuts = np.flatnonzero(np.diff(levels[order, j], prepend=levels[order[0], j] - 1))
            values = rows[order, j]
            posts.append(order.astype(np.int32))
            first.append(cuts + j * n)
            dim.append(np.full(len(cuts), j))
            low.append(np.minimum.reduceat(values, cuts))
            high.append(np.maximum.reduceat(values, cuts))
        return {"ids": ids, "rows": rows, "posts": np.concatenate(posts), "dim": np.concatenate(dim), "first": np.concatenate(first), "low": np.concatenate(low), "high": np.concatenate(high)}

    def members(self, query: np.ndarray, floor: int | None, k: int, other: np.ndarray) -> np.ndarray:
        """Rows among `other` that may belong to the k best: all whose upper bound reaches the k-th best score known."""
        if self.most * float(np.abs(query).sum(dtype=float)) >= EXACT:
            return np.flatnonzero(other)  # bounds would not be exact
        weight = query[self.dim]
        gain = np.where(weight >= 0, weight * self.high, weight * self.low)
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        bound = np.where(other, 0.0, -np.inf)  # whole numbers, exact in float64
        for part in np.array_split(order, PARTS):
            visited = np.concatenate([self.posts[self.first[x] : self.end[x]] for x in part]) if len(part) else part
            bound += np.bincount(visited, np.repeat(gain[part], self.end[part] - self.first[part]), len(bound))
            order = order[len(part) :]
            if floor is not None and len(order) and bound.max() + self._rest(order, gain) < floor:
                return np.empty(0, np.int64)
        if floor is None or (bound >= floor).sum() > FIRST:
            top = np.argpartition(-bound, min(FIRST, len(bound) - 1))[:FIRST]
            exact = np.sort(self.rows[top[other[top]]] @ query)[::-1]
            if len(exact) >= k:
                floor = max(exact[k - 1], floor if floor is not None else exact[k - 1])
        return np.flatnonzero(other & (bound >= floor)) if floor is not None else np.flatnonzero(other)

    def _rest(self, segments: np.ndarray, gain: np.ndarray) -> int:
        """R: the sum over dimensions of the largest gain among segments not yet added."""
        most = np.zeros(self.rows.shape[1], np.int64)
        np.maximum.at(most, self.dim[segments], gain[segments])
        return int(most.sum())

    def probe(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        for at, (own, query) in enumerate(zip(query_ids, impacts(queries), strict=True)):
            rows = self.members(query, best.floor(at), best.k, self.ids != own)
            if len(rows):
                best.add(at, self.ids[rows], scores_of(self.rows[rows], query))


def exact_top_k(table: DataFrame, ids: str, vectors: str, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest integer inner products, all if fewer.

    Null ids, null or empty vectors and vectors with null or non-finite components take no part, as
    queries or as candidates; an empty table gives no rows.  Repeated rows are candidates each; rows with
    the query's id are not.  Ties go to the smaller id.  Components beyond 2^54 either way count as 2^54,
    scores beyond 64 bits as the nearest long.  Other columns of `table` are ignored.
    """
    return search(table, ids, vectors, is_query, ImpactIndex, k, np.int64)
