"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

A shard's distinct unit vectors are inserted layer by layer from the top, nodes
of higher layers first.  Each layer's links live in one flat int32 array,
`width` slots a node, -1 where empty.  A new node descends the finished layers
above greedily and searches the layer as built so far with a beam; what the
beam holds, and the nodes inserted in the same step before it, are its
candidates.  The usual diversity rule keeps a candidate only if it is nearer to
the new node than to any neighbour already kept; back links are pruned by the
same rule.  Queries descend the layers in the same way and run a wider beam over
the ground layer, all queries of a block in step.  What the beam holds is
rescored in double precision, and copies of a vector are expanded to their
smallest ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from lamina.llm.vectors import Best, search

#: Links a node gets on each layer; the ground layer keeps twice as many.
LINKS = 16
#: Candidates of an insertion, and size of the beam of a search.
BUILD, BEAM = 64, 112
#: Nodes inserted together, queries searched together, nodes that a beam expands in one step.
INSERT, BLOCK, EXPAND = 256, 512, 3


def diverse(sims: np.ndarray, nodes: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (by falling similarity, -1 for none) by the diversity rule; (rows, most) with -1 padding."""
    count, width = nodes.shape
    vectors = unit[np.maximum(nodes, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    nearest = np.full((count, width), -np.inf, np.float32)  # to any kept neighbour
    out = np.full((count, most), -1, np.int32)
    kept = np.zeros(count, np.int64)
    for at in range(width):
        take = np.flatnonzero((nodes[:, at] >= 0) & (kept < most) & (nearest[:, at] < sims[:, at]))
        out[take, kept[take]] = nodes[take, at]
        kept[take] += 1
        nearest[take] = np.maximum(nearest[take], between[take, at])
    return out


class Graph:
    """The layers of one shard's graph over distinct unit vectors, ground layer first."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray]) -> None:
        self.unit, self.layers = unit, layers

    @classmethod
    def build(cls, unit: np.ndarray) -> Graph:
        draw = np.random.default_rng(len(unit)).random(len(unit))
        level = np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(np.int64)
        level[0] = max(level.max(), 0)  # the first node is the entry of every layer
        graph = cls(unit, [])
        order = np.argsort(-level, kind="stable")
        order = np.concatenate([[0], order[order != 0]])
        for at in range(int(level[0]), -1, -1):
            members = order[level[order] >= at]
            graph.layers.insert(0, graph._layer(members, int((level[members] > at).sum()), LINKS * (1 if at else 2)))
        return graph

    def _layer(self, members: np.ndarray, above: int, width: int) -> np.ndarray:
        """The links of a layer; the first `above` members are in the layer above too."""
        links = np.full((len(self.unit), width), -1, np.int32)
        at = 1
        while at < len(members):
            upto = above if at < above else len(members)
            new = members[at : min(upto, at + min(INSERT, at))]
            start = np.full(len(new), members[0]) if at < above or not self.layers else self._descend(self.unit[new], self.layers)
            found = self._beam(links, self.unit[new], start, min(BUILD, at))
            mates = np.where(np.arange(len(new))[None, :] < np.arange(len(new))[:, None], new[None, :], -1)
            near = np.concatenate([found, mates], axis=1)
            sims = np.concatenate([np.einsum("nwd,nd->nw", self.unit[np.maximum(found, 0)], self.unit[new]), self.unit[new] @ self.unit[new].T], axis=1)
            sims[near < 0] = -np.inf
            most = min(BUILD, near.shape[1])
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
            chosen = diverse(np.take_along_axis(sims, top, 1), np.take_along_axis(near, top, 1).astype(np.int32), self.unit, LINKS)
            links[new, :LINKS] = chosen
            self._back(links, np.repeat(new, LINKS), chosen.ravel())
            at += len(new)
        return links

    def _back(self, links: np.ndarray, new: np.ndarray, old: np.ndarray) -> None:
        """Links old nodes back to new ones; full lists are pruned by the diversity rule."""
        new, old = new[old >= 0], old[old >= 0]
        if not len(old):
            return
        order = np.argsort(old, kind="stable")
        new, old = new[order], old[order]
        nodes, first, count = np.unique(old, return_index=True, return_counts=True)
        width = links.shape[1]
        pool = np.full((len(nodes), width + count.max()), -1, np.int32)
        pool[:, :width] = links[nodes]
        row = np.repeat(np.arange(len(nodes)), count)
        pool[row, width + np.arange(len(old)) - np.repeat(first, count)] = new
        sims = np.einsum("nd,nwd->nw", self.unit[nodes], self.unit[np.maximum(pool, 0)])
        sims[pool < 0] = -np.inf
        rank = np.argsort(-sims, axis=1, kind="stable")
        pool, sims = np.take_along_axis(pool, rank, 1), np.take_along_axis(sims, rank, 1)
        full = (pool >= 0).sum(axis=1) > width
        links[nodes[~full]] = pool[~full, :width]
        for at in range(0, int(full.sum()), INSERT):
            some = np.flatnonzero(full)[at : at + INSERT]
            links[nodes[some]] = diverse(sims[some], pool[some], self.unit, width)

    def search(self, queries: np.ndarray) -> np.ndarray:
        """Nodes in each query's final beam, -1 where it holds fewer."""
        return self._beam(self.layers[0], queries, self._descend(queries, self.layers[1:]), BEAM)

    def _descend(self, queries: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """The node where each query's greedy descent through `layers`, from the last one, ends."""
        here = np.zeros(len(queries), np.int64)
        best = queries @ self.unit[0]
        for links in reversed(layers):
            moving = np.arange(len(queries))
            while len(moving):
                near = links[here[moving]]
                sims = np.einsum("qwd,qd->qw", self.unit[np.maximum(near, 0)], queries[moving])
                sims[near < 0] = -np.inf
                to = sims.argmax(axis=1)
                gain = sims[np.arange(len(moving)), to]
                up = gain > best[moving]
                here[moving[up]], best[moving[up]] = near[up, to[up]], gain[up]
                moving = moving[up]
        return here

    def _beam(self, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """The `width` nearest nodes that a beam from `start` finds over `links`, -1 where there are fewer."""
        count, step = len(queries), min(EXPAND, width)
        beam = np.full((count, width), -1, np.int64)
        sims = np.full((count, width), -np.inf, np.float32)
        open_ = np.zeros((count, width), bool)
        beam[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("qd,qd->q", queries, self.unit[start]), True
        seen = np.zeros((count, len(self.unit)), bool)
        seen[np.arange(count), start] = True
        going = np.arange(count)
        while len(going):
            waiting = np.where(open_[going], sims[going], -np.inf)
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            chosen = np.take_along_axis(waiting, pick, 1) > -np.inf
            live = chosen.any(axis=1)
            going, pick, chosen = going[live], pick[live], chosen[live]
            if not len(going):
                break
            rows = going[:, None]
            open_[rows, pick] = False
            near = np.where(chosen[:, :, None], links[np.maximum(beam[rows, pick], 0)], -1).reshape(len(going), -1)
            near = np.sort(near, axis=1)
            new = (near >= 0) & ~seen[rows, np.maximum(near, 0)]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            at, slot = np.nonzero(new)
            seen[going[at], near[at, slot]] = True
            score = np.full(near.shape, -np.inf, np.float32)
            score[at, slot] = np.einsum("nd,nd->n", self.unit[near[at, slot]], queries[going[at]])
            pool = np.concatenate([beam[going], np.where(new, near, -1)], axis=1)
            value = np.concatenate([sims[going], score], axis=1)
            fresh = np.concatenate([open_[going], new], axis=1)
            keep = np.argpartition(-value, width - 1, axis=1)[:, :width]
            beam[going], sims[going], open_[going] = (np.take_along_axis(x, keep, 1) for x in (pool, value, fresh))
        return beam


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings the largest component near 1: cosines stay, squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(matrix).max(axis=1, initial=0.0))
    return np.ldexp(matrix, -power[:, None])


def _others(rows: np.ndarray, first: int, after: int, k: int) -> np.ndarray:
    """The first k of ascending rows that are not in [first, after)."""
    low, high = np.searchsorted(rows, first), np.searchsorted(rows, after)
    return np.concatenate([rows[: min(low, k)], rows[high : high + k]])[:k]


class GraphIndex:
    """A shard: rows in order of id, its distinct vectors, which rows are copies of each, and the graph's layers."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.ids, self.vectors, self.lengths = arrays["ids"], arrays["vectors"], arrays["lengths"]
        self.members, self.starts = arrays["members"], arrays["starts"]
        depth = sum(name.startswith("layer") for name in arrays)
        self.graph = Graph((self.vectors / self.lengths[:, None]).astype(np.float32), [arrays[f"layer{at}"] for at in range(depth)])

    @staticmethod
    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, np.ndarray] | None:
        matrix = scaled(matrix)
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        ids, matrix, norms = ids[norms > 0], matrix[norms > 0], norms[norms > 0]
        if not len(ids):
            return None
        order = np.argsort(ids, kind="stable")
        ids, matrix, norms = ids[order], matrix[order], norms[order]
        _, first, group = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(first, kind="stable")  # distinct vectors in row order
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        group = back[group]
        first = first[rank]
        vectors, lengths = matrix[first], norms[first]
        layers = Graph.build((vectors / lengths[:, None]).astype(np.float32)).layers
        starts = np.concatenate([[0], np.cumsum(np.bincount(group))])
        return {"ids": ids, "vectors": vectors, "lengths": lengths, "members": np.argsort(group, kind="stable"), "starts": starts} | {f"layer{at}": links for at, links in enumerate(layers)}

    def probe(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        queries = scaled(queries)
        asked = np.sqrt((queries * queries).sum(axis=1))
        valid = np.flatnonzero(asked > 0)
        for at in range(0, len(valid), BLOCK):
            some = valid[at : at + BLOCK]
            beams = self.graph.search((queries[some] / asked[some][:, None]).astype(np.float32))
            for query, beam in zip(some, beams, strict=True):
                first_own, after_own = np.searchsorted(self.ids, query_ids[query]), np.searchsorted(self.ids, query_ids[query], "right")
                some_of = {x: _others(self.members[self.starts[x] : self.starts[x + 1]], first_own, after_own, best.k) for x in beam[beam >= 0].tolist()}
                nodes = np.array([x for x, rows in some_of.items() if len(rows)], np.int64)
                if not len(nodes):
                    continue
                scores = (self.vectors[nodes] * queries[query]).sum(axis=1) / (self.lengths[nodes] * asked[query])
                top = np.argsort(-scores, kind="stable")[: best.k]
                tied = np.flatnonzero(scores >= scores[top[-1]])
                rows = [some_of[int(nodes[x])] for x in tied]
                best.add(query, self.ids[np.concatenate(rows)], np.repeat(scores[tied], [len(x) for x in rows]))


def nearest(table: DataFrame, ids: str, vectors: str, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each query row by cosine.

    Scores are exact cosines in double precision.  Null ids, null, empty or all-zero vectors and vectors
    with null or non-finite components take no part, as queries or as candidates; an empty table gives no
    rows.  Repeated rows are candidates each; rows with the query's id are not.  Ties go to the smaller
    id.  Every row is indexed; other columns of `table` are ignored.
    """
    return search(table, ids, vectors, is_query, GraphIndex, k, np.float64)
