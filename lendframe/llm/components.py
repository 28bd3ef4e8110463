"""Connected components of a link table, without ever holding it in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import release, spread_join, stored


def _neighbours(edges: DataFrame) -> DataFrame:
    """Least neighbour and number of neighbours of each node a."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _neighbours(both).withColumn("m", F.least("a", "m"))
    return spread_join(both, least, ["a"], "n", 2 * size).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """edges: b < a in each."""
    least = _neighbours(edges)
    moved = spread_join(edges, least, ["a"], "n", size).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs. One row (node, root) for each node with a link; root is the smallest node reachable.

    Alternating large-star and small-star rounds; each is stored in the shared folder, so that lost executors
    cost one round at most, and the rounds end when the edge set no longer changes. A node with very many links is
    no task of its own: see ``spread_join``.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = stored(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        # a large star has as many links as what it is made from; stored, so that plans stay small
        mark, before, starred = seen, current, stored(_large_star(current, seen[0]), "links")
        current = stored(_small_star(starred, seen[0]), "links")
        release(before, starred)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Component label (the smallest index in it) of each row of a symmetric boolean matrix; -1 without a link."""
    roots = np.full(len(linked), -1)
    open_rows = linked.any(axis=1)
    while open_rows.any():
        first = int(open_rows.argmax())
        frontier = np.array([first])
        open_rows[first] = False
        roots[first] = first
        while len(frontier):
            reached = linked[frontier].any(axis=0) & open_rows
            frontier = np.flatnonzero(reached)
            open_rows[frontier] = False
            roots[frontier] = first
    return roots
