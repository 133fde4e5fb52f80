"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node of each one's component; for edges that one task holds anyway."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        lo = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], lo)
        np.minimum.at(root, root[y], lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        on = root[x] != root[y]
        x, y = x[on], y[on]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a long, b long)``: root is the least node it can reach.

    Each round writes the edges to the shared folder and stops when they no longer change. Loops of one node, repeated
    and reversed edges are allowed; edges with a null end are left out; no edges give no rows.
    """
    both = common.written(edges.where("a is not null and b is not null").distinct())
    loops = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    now = common.written(both.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        # Large star: each node's greater neighbours move to its least neighbour.
        around = now.union(now.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node and its lesser neighbours move to the least of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        now = common.written(moved.where("u != v").distinct())
        if (after := _state(now)) == state:
            break
        state = after
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
