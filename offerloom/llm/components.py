"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release_shuffles, staged


def _ends(edges: DataFrame) -> DataFrame:
    """u with its least and its greatest neighbour, for every node of ``edges``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))


def _step(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Large star: each larger neighbour of a node links to the least of the node and its
    neighbours. Then small star: a node and its smaller neighbours link to the least of them."""
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    large = up.join(ends.select("u", F.least("u", "least").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    # The neighbour that is the least itself stands for the node, so no row becomes two.
    return hung.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of ``edges`` (u, v).

    Edges shrink towards stars around the smallest nodes; each step is a map-side minimum and
    joins that Spark may split at hot nodes, and its result is written, so that lineage stays
    short and what the step before left on disk goes. The number of steps grows with the
    logarithm of the longest path. Edges that are stars already, as (node, root) of an earlier
    call are, take none: a node with a smaller neighbour then has no other.
    """
    spark = edges.sparkSession
    now = staged(edges.where("u <> v").select("u", "v"), "edges")
    while True:
        ends = staged(_ends(now), "edge-ends")
        if not ends.where("least < u AND least <> most").count():
            break
        after = staged(_step(now, ends), "edges")
        discard(now, ends)
        now = after
        release_shuffles(spark)
    discard(now)
    roots = ends.select(F.col("u").alias("node"), F.least("u", "least").alias("root"))
    roots.staged_at = ends.staged_at
    return roots
