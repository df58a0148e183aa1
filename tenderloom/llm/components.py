"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    moved = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours join the smallest one; edges point down."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u"))
    parts = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
    return parts.filter(F.col("a") != F.col("b")).distinct()


def connected_components(space: Workspace, links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b): its smallest reachable node.

    Stars converge in a number of rounds logarithmic in practice; each is written, so lineage
    stays short. Roots are not listed: a node that is missing is its own component.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = space.table(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = state
        edges = space.table(_small_stars(_stars(edges)), "edges")
