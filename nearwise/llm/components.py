"""Connected components of a graph too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): root is the smallest node reachable. Roots, and nodes without
    an edge to another, do not appear as nodes. Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the graph."""
    # node over lower: each edge from its greater end
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = save(both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m")))
        large = both.join(least, "node").where(F.col("root") > F.col("node"))
        large = save(large.select(F.col("root").alias("node"), F.col("m").alias("root")).distinct())
        least = save(large.groupBy("node").agg(F.min("root").alias("m")))
        small = large.join(least, "node").where(F.col("root") > F.col("m")).select(F.col("root").alias("node"), F.col("m").alias("root"))
        edges = save(small.unionByName(least.withColumnRenamed("m", "root")).distinct())
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
