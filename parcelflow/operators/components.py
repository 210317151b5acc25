"""Connected components within keys, by alternating star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.sources.scratch import Scratch

MOST = 64


def met(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with other by a shuffle: tables that grow with the input would be broadcast up to a size that counts packed bytes, and once a round, all through the driver."""
    return rows.join(other.hint("merge"), on, how)


def _least(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))


def _large(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node's larger neighbours go to the least of the node and all its neighbours."""
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    rows = met(both, _least(both, keys), [*keys, "a"]).where("b > a")
    return rows.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node and its smaller neighbours go to the least of these."""
    least = _least(edges, keys)
    rows = met(edges, least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return rows.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).where("a > b").distinct()


def connected(scratch: Scratch, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of edges (keys, a, b) of longs: keys, node and root, the least node reachable, for every node with an edge.

    A round's minima are combined in map tasks, so a node of many edges isn't one task's; rounds grow
    with the logarithm of a component's diameter and end when every node hangs on a root.
    """
    e = edges.where("a != b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.put(e, "edges")
    for _ in range(MOST):
        inner = e.select(*keys, F.col("b").alias("a")).distinct()
        many = e.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, "a")
        if met(e, inner.unionByName(many), [*keys, "a"], "left_semi").isEmpty():
            return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = scratch.put(_small(_large(e, keys), keys), "edges")
    raise RuntimeError("components did not settle")
