"""Connected components by large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node, component (its least node) for every node of an edge between two nodes.

    Each round keeps at most as many edges as before. The least neighbour of a node comes from an aggregation and is
    joined back, so a node with very many neighbours is no single task's load. Every round is written to the shared
    folder, where the next one starts; there are about log2 of the longest path, until one changes nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        before, state = state, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
