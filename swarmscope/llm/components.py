"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmscope.llm.storage import drop, save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given edges do: each node with the least of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("node", "root"), 20)), F.bit_xor(F.xxhash64("node", "root"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: longs) other than a root itself: the least node it is linked with.

    Stars are minima and equi-joins over edges; nothing gathers a node's neighbours in one row, and each round's edges
    are written to the shared folder.
    """
    found = save(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    before = state(found)
    while before[0]:
        both = found.union(found.select("root", "node"))
        # written, so that the joins' sides are plain tables, whose hot nodes Spark can split
        least = save(both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least")), "edges-least")
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        large = save(large, "edges-large")
        lower = save(large.groupBy("node").agg(F.min("root").alias("least")), "edges-least")
        small = large.join(lower, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("least").alias("root")), F.struct("node", F.col("least").alias("root")))).alias("edge"))
        now = save(small.select("edge.*").where("node <> root").distinct(), "edges")
        for done in (found, least, large, lower):
            drop(done)
        found, after = now, state(now)
        if after == before:
            break
        before = after
    return found
