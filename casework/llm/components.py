"""Connected components of a graph given as links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest_roots(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node with a parent: the root of its tree.

    ``parents`` has ``node, parent``, one parent for a node, and no circles. Every round
    jumps from the parent to what the parent points at, so the rounds are logarithmic in
    the height and each one reads a row per node.
    """
    state, step = scratch.table(parents.select("node", "parent"), f"{name}-0"), 0
    while True:
        above = state.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = state.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        step += 1
        found = scratch.table(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        if found.filter("moved").isEmpty():
            return found.select("node", F.col("parent").alias("component"))
        state = found.select("node", "parent")


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node that it can reach.

    Alternates the large-star and small-star steps, which need a logarithmic number of
    rounds, and writes the links between rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = scratch.table(edges, f"{name}-0")
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step += 1
        edges = scratch.table(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
