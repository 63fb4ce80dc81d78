"""Connected components of an undirected edge list.

Every task first unites the edges it holds (union-find), which leaves a star per component and task. Then rounds of two steps: the edges are
dealt by their child and united again, so a node's parents become one; and every edge moves up to its parent's parent. A round
costs one shuffle by child and one join with a row per child, at most as many rows as nodes; a hub is many children's parent and never a key that gathers them.
Paths halve in each round. Each round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leeward.llm.shared import staged

STAR = "u long, v long"


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes that are not the least, for the edges (a, b)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    one, other = np.maximum(place[:len(a)], place[len(a):]), np.minimum(place[:len(a)], place[len(a):])
    while True:
        x, y = up[one], up[other]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:                                     # all the way to the roots
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[child], nodes[up[child]]


def _unite(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        u, v = unite(*(np.concatenate(c) for c in zip(*held)))
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i:i + (1 << 16)]), pa.array(v[i:i + (1 << 16)])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component."""
    current = edges.where("a != b").select("a", "b").mapInArrow(_unite, STAR)
    while True:
        current = staged(current.repartition("u").mapInArrow(_unite, STAR), "stars")
        up = current.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # At rest no node has two parents, and no parent has one.
        left = current.join(up, current["v"] == up["x"], "left_semi").limit(1).union(up.where("n > 1").select("x", "m").limit(1))
        if not left.limit(1).count():
            break
        current = current.join(up, current["v"] == up["x"], "left").select("u", F.coalesce("m", "v").alias("v"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
