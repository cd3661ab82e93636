"""Connected components of a table of links, by alternating star operations in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import cut_lineage


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and its label, the smallest node of its component; links: two long columns. Nodes without a link have no row.

    A large star hangs a node's larger neighbours on its smallest one, a small
    star its smaller ones; the links become one star per component in about
    log(n) rounds. Links stay on the executors; each round is one checkpoint.
    """
    a, b = links.columns
    edges = cut_lineage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done = cut_lineage(hung.where("u > v").distinct())
        # stars: no node is both a child and a parent, and none is the child of two
        roles = done.select("u").union(done.select("v").distinct()).groupBy("u").count()
        if roles.where("count > 1").isEmpty():
            return done.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                done.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        edges = done
    raise RuntimeError("components did not settle")
