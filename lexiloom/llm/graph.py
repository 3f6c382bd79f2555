"""Connected components of an edge table, distributed: smallest labels spread along edges, and labels take their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reached) of every node of edges (a, b). Each round gives a node the smallest of
    its neighbours and itself, and goes on with the edges between such labels; edges inside a label drop out, so the graph
    shrinks quickly. A node's component is its label's. Every round is a written table."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).unionByName(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low")))
        labels = written(ends.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("component")), "labels")
        steps.append(labels)
        # Both sides of each join are scans, so AQE splits a node with very many edges.
        left = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        moved = edges.join(left, "a").select("la", "b").distinct().join(right, "b").where("la <> lb")
        before = edges
        edges = written(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        dropped(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    dropped(edges)
    out = steps[-1]
    for labels in reversed(steps[:-1]):
        last, final = out, out.select(F.col("node").alias("n"), F.col("component").alias("f"))
        out = written(labels.join(final, labels["component"] == F.col("n"), "left").select("node", F.coalesce("f", "component").alias("component")), "labels")
        dropped(last, labels)
    return out
