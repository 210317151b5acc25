"""Component trees: how the components of grey planes split as a threshold rises.

Runs of all asked thresholds are labelled in one contraction, with the threshold as a part of the key. The
component of the threshold below that holds a component's first pixel is its parent: sets
shrink as thresholds rise, so one pixel tells. A plane's every value can be asked for; the work
grows with the runs of the thresholds asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.operators import runs as R
from parcelflow.sources.scratch import Scratch


def level_parts(scratch: Scratch, rows: DataFrame, keys: list[str], values: str, levels: list[int]) -> DataFrame:
    """Labelled runs (keys, level, y, x0, x1, v, component) of the values of rows (keys, y, values) that reach each level."""
    every = rows.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    return scratch.put(R.labelled(scratch, R.of_rows(every, [*keys, "level"], values, lambda v: v >= F.col("level")), [*keys, "level"]), "levels")


def holders(nodes: DataFrame, parts: DataFrame, keys: list[str], below: Column, name: str) -> DataFrame:
    """nodes (keys, level, component, y, x: a pixel of theirs) with the component of level below that holds the pixel; null if below is."""
    strip = F.explode(F.sequence(F.floor(F.col("x0") / R.STRIP), F.floor((F.col("x1") - 1) / R.STRIP)))
    there = parts.select(*keys, F.col("level").alias("_l"), "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("component").alias(name), strip.alias("_s"))
    here = nodes.withColumn("_l", below).withColumn("_s", F.floor(F.col("x") / R.STRIP))
    met = here.join(there, [*keys, "_l", "y", "_s"]).where("x >= _a and x < _b").select(*keys, "level", "component", name)
    return nodes.join(met, [*keys, "level", "component"], "left")


def component_tree(scratch: Scratch, rows: DataFrame, keys: list[str], values: str, levels: list[int]) -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, level, component, area, box, centre, peak, y and x of the first pixel, parent, base) and the runs they are made of.

    parent: component of the next lower level (null at the lowest); base: component of the lowest level.
    """
    levels = sorted(levels)
    parts = level_parts(scratch, rows, keys, values, levels)
    first = F.min(F.struct("y", F.col("x0").alias("x")))
    nodes = R.shapes(parts, [*keys, "level"], first.alias("_f"), F.max(F.array_max("v")).alias("peak")).withColumn("y", F.col("_f.y")).withColumn("x", F.col("_f.x")).drop("_f")
    nodes = scratch.put(nodes, "nodes")
    lower = F.create_map(*(F.lit(x) for k in range(1, len(levels)) for x in (levels[k], levels[k - 1]))) if len(levels) > 1 else F.create_map().cast("map<int,int>")
    nodes = scratch.put(holders(nodes, parts, keys, F.try_element_at(lower, F.col("level")), "parent"), "parents")
    return scratch.put(holders(nodes, parts, keys, F.lit(levels[0]), "base"), "bases"), parts


def splits(nodes: DataFrame, keys: list[str], least: int) -> DataFrame:
    """For each component of the lowest level that falls apart: the lowest level at which two or more parts of at least so many pixels stand, how many, and their pixels."""
    large = nodes.where(F.col("area") >= least).groupBy(*keys, "base", "level").agg(F.count(F.lit(1)).alias("cores"), F.sum("area").alias("core_area")).where("cores > 1")
    return large.groupBy(*keys, F.col("base").alias("component")).agg(F.min(F.struct("level", "cores", "core_area")).alias("s")).select(*keys, "component", "s.*")


def survival(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """For each component of the lowest level and each level: how many parts and pixels stand."""
    return nodes.groupBy(*keys, F.col("base").alias("component"), "level").agg(F.count(F.lit(1)).alias("parts"), F.sum("area").alias("pixels"))


def stability(median: Column, core: Column, seeds: Column, low: Column, high: Column) -> Column:
    """How much of a component stays at a higher low threshold (core) and reaches the high one (seeds), and its median's margin; 0 to 1."""
    one = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    margin = one((median - low) / F.greatest(F.lit(1.0), high - low))
    # Shares that count as full, and the weights of the three.
    return one(F.least(F.lit(1.0), core / 0.55) * 0.42 + F.least(F.lit(1.0), seeds / 0.12) * 0.34 + margin * 0.24)
