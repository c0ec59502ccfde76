"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import stash


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given pairs connect; used inside tasks."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, both long, not null); root is the smallest node reachable.

    Every round is two joins on aggregated minima, written to the shared folder;
    rounds grow with the logarithm of the longest path. Only a count and a
    checksum reach the driver. Self-loops and repeated edges are harmless.
    """
    now = stash(_descending(edges.select("a", "b")), "edges")
    seen = _signature(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _descending(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stash(_descending(small.union(least.select("a", F.col("m").alias("b")))), "edges")
        before, seen = seen, _signature(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _descending(edges: DataFrame) -> DataFrame:
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return edges.where("a <> b").select(high, low).distinct()


def _signature(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
