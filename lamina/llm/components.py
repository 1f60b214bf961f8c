"""Connected components of an edge table, without a task that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour, itself included; `edges` is (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    others = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of `edges` (a, b), itself included.

    Large stars and small stars alternate until every node is tied to its root alone, which takes a number of
    rounds that grows with the logarithm of the nodes, however they are numbered.  Minima are combined before
    the shuffle and the joins' large side may be split, so a hub needs no task of its own.  Each round is
    written, so lost executors repeat little.  Repeated edges and edges of a node to itself tie nothing more;
    a node with such an edge only is its own root; without edges there are no rows.
    """
    own = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(state)
    while True:
        after = materialize(_small_star(_large_star(state)), "edges")
        discard(state)
        state, now = after, mark(after)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).unionByName(own)
    out = materialize(roots.groupBy("node").agg(F.min("root").alias("root")), "roots")
    discard(state)
    return out
