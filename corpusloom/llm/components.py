"""Connected components of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) is the only one of its a, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node that links reach.

    Large stars join each node's larger neighbours to its smallest one; small stars
    join its smaller neighbours to the smallest. Each round keeps the components and
    the number of edges doesn't grow; rounds end when only stars are left, after about
    log^2 of the longest chain. Nothing is collected; every round is written to the
    shared folder, and the one before it deleted. Loops, repeated links and links to
    null are ignored.
    """
    held = Scratch(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = held.keep(edges, "edges")
    while not _are_stars(edges):
        near = _both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, held = held, Scratch(links.sparkSession)
        edges = held.keep(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        before.discard()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
