"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: each node's greater neighbours meet its least one.  Small star: its lesser
    neighbours and itself do.  The least neighbour is an aggregate and rows meet it in a join,
    so no node's neighbours are ever gathered."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger \
        else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges(a bigint, b bigint)``; a component is called
    by its least node.  Every round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path."""
    edges = written(edges.where("a <> b").dropDuplicates(), "edges")
    mark = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))
    before = None
    while (now := tuple(edges.agg(*mark).first())) != before:
        before = now
        edges = written(_stars(_stars(edges, True), False), "edges")
    least = edges.select(F.col("b").alias("node")).dropDuplicates().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
