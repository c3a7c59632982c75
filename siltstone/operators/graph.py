"""Walks over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut_lineage


def traverse(edges: DataFrame, start: DataFrame, depth: int, kinds: list[str] | None = None, directed: bool = True) -> DataFrame:
    """node, depth and path of every node reached from ``start`` (column node) within ``depth`` steps, each by its shortest, then least path.

    One join per step; nodes already reached are not walked again, so cycles end and the
    frontier never holds a node twice. Edges need src, dst and kind.
    """
    chosen = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    steps = chosen.select("src", "dst")
    if not directed:
        steps = steps.union(chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = steps.distinct()
    reached = start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    frontier = reached
    for step in range(1, depth + 1):
        onward = frontier.join(steps, frontier.node == steps.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = onward.join(reached.select("node"), "node", "left_anti")
        frontier = cut_lineage(fresh.groupBy("node").agg(F.min("path").alias("path")).select("node", F.lit(step).alias("depth"), "path"))
        reached = reached.unionByName(frontier)
    return reached
