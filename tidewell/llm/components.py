"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node, by partial sums, so that a hub's neighbours are never in one place."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a hub's rows meet one row: the adaptive skew join may split them
    met = both.where("b > a").join(_least(both), "a")
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = down.join(_least(down), "a")
    return (
        linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)`` that isn't its component's least node.

    A round keeps the components and shortens the paths to the least node; after
    about log(n) rounds all edges point at it. Each round is cut from the one
    before in the shared folder. Self loops and repeated edges are allowed.
    """
    current, seen = cut(edges.where("a is not null and b is not null and a <> b").distinct()), None
    while True:
        at = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(at) or not at[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(at)
        current = cut(_small(_large(current)))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect whatever the edges (a, b) connect."""
    if len(a) < 3:
        return a, b
    nodes, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = local[: len(a)], local[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]
