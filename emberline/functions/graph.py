"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import by_shuffle, cut_lineage, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node it can reach, itself included.

    Links are undirected; repeated links, self links and links with a NULL end are harmless (the
    last two link nothing). Each half round moves every node's neighbours to the smallest of them,
    so the number of rounds grows with the logarithm of the longest chain. A node's minimum is a
    table of its own before it meets the node's links, so a hub is a join that adaptive execution
    can split. These tables have a row per node, in small files: no round collects one on the driver.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut_lineage(ends.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut_lineage(by_shuffle(both.where("v > u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        rest = by_shuffle(large).join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut_lineage(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for old in (edges, low, large, least):
            release(old)
        edges = small
        # Stars: nobody has two parents and no parent has a parent.
        again = edges.groupBy("u").count().where("count > 1").select("u").unionByName(
            by_shuffle(edges).join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u"))
        if again.isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
