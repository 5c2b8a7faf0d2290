"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, bool]:
    """One step on distinct edges (u > v): neighbours link to the least of their neighbourhood. Also, whether any edge moved."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    # Written first: the join then has a plain exchange on either side, and AQE can split a hub's rows.
    least = materialize(both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    joined = both.join(least, both.u == least.c)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
    else:
        own = least.select(F.col("c").alias("u"), F.col("m").alias("v"), F.lit(False).alias("moved"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("moved")).unionByName(own)
    # A move can end in a loop, which goes only after it was seen.
    out = materialize(moved.groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
    return out.where("u <> v"), not out.where("moved").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns u, v); a component is named by its least node.

    The edges shrink to stars; the steps stop when neither of them moves an edge.
    Loops and repeated edges are ignored; no edges give no rows.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    moved = True
    while moved:
        now, large = _star(now, large=True)
        now, small = _star(now, large=False)
        moved = large or small
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
