"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.stage import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that has a link to another one; root is the smallest node reachable.

    Alternates the two star operations: hang every larger neighbour below the smallest one, then every smaller one, until
    no node is both above and below. Each round is two joins of staged tables, so a node that a third of all links share
    is dealt by the skew join; nothing is collected. Nulls and links from a node to itself are ignored.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = staged(links.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
        both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "stars")
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(large.where("a <> b").distinct(), "edges")
        least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(hung.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
