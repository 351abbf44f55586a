"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours are linked to its least neighbour: larger ones, or the smaller ones and itself.

    The least neighbour comes from an aggregate and goes back by a join, so the neighbours of a node never meet in
    one row or task.  Repeated links take next to nothing in files, by whose size Spark would broadcast them.
    """
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = edges.unionByName(swapped) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = sides.join(least.hint("merge"), "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the component is its least node.

    Nodes are of any one ordered type; links may repeat, point either way or join a node to itself (such a link adds
    no row).  No links give no rows.  Every round is written to the shared folder; only two totals of a round come to
    the driver.
    """
    edges = scratch.cut(links.select("a", "b").where("a <> b"), "links")
    before = None
    while True:
        wide = scratch.cut(_stars(edges, True), "large-star")
        after = scratch.cut(_stars(wide, False), "small-star")
        scratch.drop(edges, wide)
        edges = after
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
