"""Connected components by alternating large-star and small-star steps, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.store import Scratch

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links nodes to the smallest among a node and its neighbours.

    large: from every node those of its neighbours that are larger; else the node and its
    smaller neighbours. Minima are taken by partial aggregation and joined back, so a node of
    many neighbours is no group in one task; the join is one that Spark can split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From edges (a, b) of longs: node, root (smallest node reachable) of every node that has an edge.

    Self-loops, repeated edges and either direction are fine; null ends are left out; no edges
    give no rows. Each round's edges are written to the shared folder; the number of rounds
    grows with the logarithm of a component's diameter.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.put(e, "edges-0")
    before = None
    for i in range(1, MAX_ROUNDS + 1):
        if e.isEmpty():
            break
        e2 = scratch.put(_star(_star(e, True), False), f"edges-{i}")
        mark = e2.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{i - 1}")
        e = e2
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
