"""Connected components of a link table by alternating star contraction; every step is an aggregate and a join on the node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.operators.reuse import written


def _star(arcs: DataFrame, larger: bool) -> DataFrame:
    """One contraction. `larger`: larger neighbours move to the least one; else the smaller ones and the node itself do."""
    if larger:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v: bigint, undirected, without nulls); component is the least node reached.

    Self links and repeated links are allowed; an empty table gives an empty one. The number of steps grows with the logarithm of
    the longest path. Each step's links are written to the shared folder, so lineage ends there.
    """
    arcs = written(links.select("u", "v").where("u <> v").distinct(), "links")
    state = None
    while True:
        arcs = written(_star(_star(arcs, True), False), "links")
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    least = arcs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return least.unionByName(arcs.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
