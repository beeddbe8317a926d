"""Connected components on DataFrames by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join on the node, in which the
skew join splits a hub with very many neighbours.  Edges are first thinned to a spanning
forest inside each partition, then in partitions merged to some `TASK_EDGES`; where one such
partition holds them all, its forest is the result without a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut

#: Edges of a merged partition, about; more edges are in more partitions.
TASK_EDGES = 1 << 18


class Forest:
    """Union-find over arbitrary integers; the root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while (up := p.get(x, x)) != root:
            p[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x in self.parent if self.find(x) != x]
        return np.array(nodes, dtype=np.int64), np.array([self.find(x) for x in nodes], dtype=np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        pairs = np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), axis=0)
        for a, b in pairs.tolist():
            forest.join(a, b)
        if len(forest.parent) > 2_000_000:
            src, dst = forest.pairs()
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            forest = Forest()
    src, dst = forest.pairs()
    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge out, or only edges in: then the edges are stars."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("dst", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest member) of every node with an edge; edges: src, dst (bigint).

    No edges give no rows.  Self loops are ignored, repeated edges count once.
    """
    now = cut(edges.select("src", "dst").where("src <> dst").mapInArrow(_thin, "src bigint, dst bigint"))
    parts = max(1, ceil(now.count() / TASK_EDGES))
    if parts < now.rdd.getNumPartitions():
        now = cut(now.coalesce(parts).mapInArrow(_thin, "src bigint, dst bigint"))
    now = now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    for _ in range(limit):
        if parts == 1 or _settled(now):
            break
        # large star: larger neighbours of a node are linked to the smallest of it and its neighbours
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("dst"), F.least("src", "m").alias("m"))
        large = _looked_up(now, least).where("src <> m").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest
        large = cut(large.select("src", F.col("m").alias("dst")))
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = _looked_up(large.select(F.col("dst").alias("src"), F.col("src").alias("dst")), least.select(F.col("src").alias("dst"), "m"))
        small = small.where("src <> m").select("src", F.col("m").alias("dst"))
        now = cut(small.union(least.select("src", F.col("m").alias("dst"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)


def _looked_up(edges: DataFrame, least: DataFrame) -> DataFrame:
    """src, m of each edge: m is that of dst.

    `least` is stored first, so both sides of the join come straight from a shuffle: only then
    does the skew join split the edges of a hub.
    """
    return edges.join(cut(least), "dst").select("src", "m")
