"""Connected components of a graph of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Links are hung from the smallest node seen so far, first those to larger neighbours, then those to smaller
    ones, until nothing changes. The number of rounds follows the logarithm of the longest chain. Each round is a
    grouped minimum and an equi-join, and is written to the shared folder.
    """
    edges = written(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low < high").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(smallest, "high").select(
            F.col("m").alias("low"), F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"))
        # Every node but a root keeps a link down, so stars are what is left when no node has two.
        after = written(small.where("low < high").distinct(), "links")
        moved = after.join(edges, ["low", "high"], "left_anti")
        if moved.isEmpty() and after.count() == edges.count():
            break
        edges = after
    roots = edges.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)
