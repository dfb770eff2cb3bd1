"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links(a, b)``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each link is moved to the smallest neighbour until every component is a
    star around its smallest node. A hub's links are reduced by partial
    minima and joined back, so no task holds the neighbours of one node.
    Links with a null end and links of a node to itself are ignored.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # Stars: no centre is linked to a smaller node, and no node has two centres.
        if edges.isEmpty() or _all_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def _all_stars(edges: DataFrame) -> bool:
    centres = edges.select("b").distinct()
    chained = edges.join(centres.withColumnRenamed("b", "centre"), F.col("a") == F.col("centre"), "left_semi")
    double = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return chained.select("a").unionByName(double.select("a")).isEmpty()
