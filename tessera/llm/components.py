"""Connected components of a link table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scale import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link between two nodes.

    Alternates two steps until nothing changes, each linking neighbours to a smaller node: over larger
    neighbours to the smallest neighbour, then over smaller ones. Ends in stars around the smallest
    nodes after about log^2 of the longest path. Every step is an aggregation by node, combined before
    the shuffle, and a join with its one row per node, so a node with many links is split by the
    skew join. Rounds are cut by reliable checkpoints. Self-links and repeated links are allowed; a
    NULL end is no link.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct()
    edges = cut_lineage(edges)
    while True:
        # large star: u's larger neighbours move to u's smallest neighbour
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = cut_lineage(large.where(F.col("u") != F.col("v")).distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
        small = cut_lineage(small.where(F.col("u") != F.col("v")).distinct())
        change = small.select("u", "v", F.lit(1).alias("n")).union(edges.select("u", "v", F.lit(-1).alias("n")))
        if change.groupBy("u", "v").agg(F.sum("n").alias("n")).where("n != 0").isEmpty():
            break
        edges = small
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
