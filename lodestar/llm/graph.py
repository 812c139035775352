"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b")


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges have a < b."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    linked = edges.withColumnRenamed("b", "u").join(least, "u").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("u").alias("y"))
    return linked.union(own).where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node, or only to larger ones: then labels are found."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(0).alias("later")), F.struct(F.col("b").alias("u"), F.lit(1).alias("later")))).alias("e"))
    per = sides.groupBy("e.u").agg(F.sum("e.later").alias("later"), F.count("*").alias("times"))
    return per.where("later > 0 and times > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b): label is the least node of its component.

    Only aggregates and joins run over the edges, so a hub's links never meet in one task as a group.
    """
    now = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not are_stars(now):
        now = materialise(small_star(large_star(now)))
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())
