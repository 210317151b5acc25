"""Greedy choices in a fixed order, by rounds of what is decided already; no pass over a group.

What a sequential pass decides for a row depends only on earlier rows that compete with it, so
in each round all rows are decided whose earlier competitors are. The first undecided row of each key always
is; states are written between rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.sources.scratch import Scratch


def first_independent(scratch: Scratch, nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of nodes (keys, r) taken by r, each is kept unless an earlier kept one is its neighbour: keys, r and into, the first such neighbour or r itself.

    edges: (keys, lo, hi) with lo < hi, distinct. r is unique within keys.
    """
    rows = nodes.select(*keys, "r").join(absorbed(scratch, edges, keys), [*keys, "r"], "left")
    return rows.select(*keys, "r", F.coalesce("into", "r").alias("into"))


def absorbed(scratch: Scratch, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Those that first_independent() doesn't keep, with into. Nodes without an edge are never looked at."""
    edges = scratch.put(edges.select(*keys, "lo", "hi"), "edges")
    later = edges.select(*keys, F.col("hi").alias("r")).distinct()
    fresh = scratch.put(edges.select(*keys, F.col("lo").alias("r")).distinct().join(later, [*keys, "r"], "left_anti"), "kept")
    kept, gone, open_ = [fresh], [], edges
    while True:
        out = open_.join(fresh.withColumnRenamed("r", "lo"), [*keys, "lo"], "left_semi").select(*keys, F.col("hi").alias("r")).distinct()
        out = scratch.put(out, "gone")
        gone.append(out)
        rest = open_.join(out.withColumnRenamed("r", "hi"), [*keys, "hi"], "left_anti")
        asked = rest.select(*keys, F.col("hi").alias("r")).distinct()
        rest = scratch.put(rest.join(out.withColumnRenamed("r", "lo"), [*keys, "lo"], "left_anti"), "open")
        fresh = scratch.put(asked.join(rest.select(*keys, F.col("hi").alias("r")).distinct(), [*keys, "r"], "left_anti"), "kept")
        if fresh.isEmpty():
            break
        kept.append(fresh)
        open_ = rest
    all_kept = reduce(DataFrame.unionByName, kept)
    into = edges.join(all_kept.withColumnRenamed("r", "lo"), [*keys, "lo"], "left_semi").groupBy(*keys, F.col("hi").alias("r")).agg(F.min("lo").alias("into"))
    return reduce(DataFrame.unionByName, gone).join(into, [*keys, "r"]).select(*keys, "r", "into")


def first_matching(scratch: Scratch, wishes: DataFrame, keys: list[str]) -> DataFrame:
    """Of wishes (keys, left, right, rank), lefts in ascending order take the free right of the least rank: keys, left, right (null if none is free).

    A left takes its best free right once no earlier undecided left wishes for it.
    """
    wishes = scratch.put(wishes.select(*keys, "left", "right", "rank"), "wishes")
    open_, found = wishes, []
    while True:
        best = open_.groupBy(*keys, "left").agg(F.min(F.struct("rank", "right")).alias("b")).select(*keys, "left", F.col("b.right").alias("right"))
        first = open_.groupBy(*keys, "right").agg(F.min("left").alias("_f"))
        taken = scratch.put(best.join(first, [*keys, "right"]).where("_f = left").select(*keys, "left", "right"), "taken")
        found.append(taken)
        open_ = open_.join(taken.select(*keys, "left"), [*keys, "left"], "left_anti").join(taken.select(*keys, "right"), [*keys, "right"], "left_anti")
        open_ = scratch.put(open_, "open")
        if open_.isEmpty():
            break
    return wishes.select(*keys, "left").distinct().join(reduce(DataFrame.unionByName, found), [*keys, "left"], "left")
