"""Connected components of a large edge table, by alternating star contractions.

Every round is two shuffles: *large star* hangs each larger neighbour on the smallest one, *small star* hangs a
node's smaller neighbours on their minimum.  Stars remain after O(log^2 n) rounds.  A hub is folded with map-side
minima before its edges move, and joins with it are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import cut, drop_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours ``v`` of every ``u`` on the least of them and ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u")
    if larger:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges between comparable ids -> (node, root), root the least node; nodes without an edge are not listed.

    Self loops, repeated and reversed edges change nothing; an empty table gives an empty result.  Rounds end when
    an edge table repeats itself, told by its count and an order-free checksum.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1000000007).cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        large = _star(_both(now), larger=True).distinct()
        small = _star(large.where("v < u"), larger=False).where("u <> v").distinct()
        after = cut(small)
        drop_table(now)
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For edges among lanes 0..n-1, each linked lane with the least lane of its component (vectorised label passing)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    lanes = np.flatnonzero(root != np.arange(n))
    return lanes, root[lanes]
