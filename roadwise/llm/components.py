"""Connected components of an edge table, by alternating large and small stars.

Each round joins the edges with the smallest neighbour of every node, so a node with very
many edges is only ever pre-aggregated (a minimum) and joined, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every edge (u, v) is the only one of u and v has none of its own: all stars."""
    n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b). The
    rounds end when all that is left are stars, however many that takes."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = materialise(e, "edges")
    while not _settled(e):
        e = materialise(_star(_star(e, True), False), "stars")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
