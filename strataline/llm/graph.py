"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, small_or_shuffled, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step: (u, v) with u > v in and out; neighbours of u are joined to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    joined = both.join(small_or_shuffled(least), "u")
    moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    after = written(moved.filter("u > v").distinct(), "star-edges")
    deleted(least)
    return after


def _stars_only(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u: nothing is left to join."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) to (id, component): the smallest id that each id with an edge can reach.

    Alternating large-star and small-star steps: the edges shrink to one star for each component
    in a number of rounds that grows with the logarithm of its size. A vertex with very many
    neighbours is pre-aggregated and joined with a broadcast if few vertices are left, else by a sort-merge join that Spark can split.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "star-edges")
    while not _stars_only(now):
        half = _star(now, large=True)
        deleted(now)
        now = _star(half, large=False)
        deleted(half)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
