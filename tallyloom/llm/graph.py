"""Connected components: union-find in one task where the edges are few, alternating stars beyond.

A round of stars is a few joins and aggregations over the edges that are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import F, T, batch_of, stage

#: Edges (16 bytes each) that one task may hold.
FEW = 2_000_000


def _union(batches):
    """node, comp for all edges of the task."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not pairs:
        return
    nodes, flat = np.unique(np.concatenate([x for ab in pairs for x in ab]), return_inverse=True)
    up = list(range(len(nodes)))
    at = 0
    for a, b in pairs:
        for x, y in zip(flat[at : at + len(a)].tolist(), flat[at + len(a) : at + 2 * len(a)].tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
        at += 2 * len(a)
    for i, x in enumerate(up):  # a parent is never larger, so its root is known
        up[i] = up[x]
    yield batch_of(T.StructType([T.StructField("node", T.LongType()), T.StructField("comp", T.LongType())]), (nodes, nodes[up]))


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, comp from undirected edges ``a``, ``b`` (long): ``comp`` is the least node that it hangs together with.

    Only nodes with an edge to another node appear. Equal edges and loops do no harm. Beyond ``few`` edges no step gathers a component
    in one task: sums and minima combine before the shuffle, and the joins have one row for each node on one side, so that Spark can
    split a hot one.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if e.count() <= few:
        return stage(e.coalesce(1).mapInArrow(_union, "node long, comp long"), "components")
    mark = None
    for _ in range(rounds):
        # Large star: whoever is larger than u hangs on the least around u.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, "large")
        # Small star: u and all that is smaller around it hang on the least.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = stage(small.filter("a <> b").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
