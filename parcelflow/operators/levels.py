"""Threshold statistics from histograms: one array of 256 counters for each cell, added element by element.

Medians, deviations, percentiles, the filter of the extreme tail and the clamp of cells to their frame's
thresholds come from counters by array functions; pixels are read once, and sums of counters
merge in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.settings import Settings
from parcelflow.operators.stencils import let
from parcelflow.sources.scratch import Scratch

VALUES = 256


def counters(rows: DataFrame, keys: list[str], value: str, **kinds: Column) -> DataFrame:
    """For each of keys an array of counters of the bytes in value for each kind (a condition); rows of one value meet in map tasks."""
    hist = rows.groupBy(*keys, F.col(value).cast("int").alias("_v")).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))
    full = lambda n: F.map_from_entries(F.collect_list(F.struct("_v", n)))  # noqa: E731  256 entries at most
    made = hist.groupBy(*keys).agg(*(full(n).alias(n) for n in kinds))
    spread = lambda n: F.transform(F.sequence(F.lit(0), F.lit(VALUES - 1)), lambda v: F.coalesce(F.try_element_at(F.col(n), v), F.lit(0)))
    return made.select(*keys, *(spread(n).alias(n) for n in kinds))


def added(rows: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Counters of cells added up to those of keys."""
    zip_ = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    start = F.array_repeat(F.lit(0).cast("long"), VALUES)
    flat = rows.groupBy(*keys).agg(*(F.collect_list(n).alias(n) for n in kinds))  # as many as a frame has cells
    return flat.select(*keys, *(F.aggregate(n, start, zip_).alias(n) for n in kinds))


def size(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)


def _at(pairs: Column, rank: Column) -> Column:
    """The value at a rank (from 0) of sorted (value, count)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
    step = lambda r: lambda s, p: F.struct((s["n"] + p["n"]).alias("n"), F.when(s["v"].isNull() & (s["n"] + p["n"] > r), p["v"]).otherwise(s["v"]).alias("v"))
    return let(rank, lambda r: F.aggregate(pairs, start, step(r), lambda s: s["v"]))


def _pairs(c: Column) -> Column:
    return F.transform(c, lambda n, v: F.struct(v.cast("double").alias("v"), n.alias("n")))


def _middle(pairs: Column, n: Column) -> Column:
    return F.coalesce((_at(pairs, F.floor((n - 1) / 2)) + _at(pairs, F.floor(n / 2))) / 2, F.lit(0.0))


def with_spread(scratch: Scratch, rows: DataFrame, c: str, median: str, mad: str) -> DataFrame:
    """rows with the median and the median absolute deviation of counters c (0 if it is empty); written between steps, as each reads the one before often."""
    rows = scratch.put(rows.withColumn(median, _middle(_pairs(F.col(c)), size(F.col(c)))), "median")
    away = F.array_sort(F.transform(c, lambda n, v: F.struct(F.abs(v.cast("double") - F.col(median)).alias("v"), n.alias("n"))))
    return scratch.put(rows.withColumn(mad, _middle(away, size(F.col(c)))), "mad")


def rank(c: Column, p: float) -> Column:
    """Nearest-rank percentile of counters; 0 if there are none."""
    return F.coalesce(_at(_pairs(c), F.floor((size(c) - 1) * p + 0.5)), F.lit(0.0))


def without_tail(scratch: Scratch, rows: DataFrame, c: str, out: str, s: Settings) -> DataFrame:
    """rows with counters out: those of c without values far above their median."""
    rows = with_spread(scratch, rows, c, "_m", "_d")
    top = F.col("_m") + s.tail_mads * F.greatest(F.lit(2.0), F.col("_d"))
    return rows.withColumn("_top", top).withColumn(out, F.transform(c, lambda n, v: F.when(v <= F.col("_top"), n).otherwise(0))).drop("_m", "_d", "_top")


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(low, high), F.greatest(low, x))


def _limits(scratch: Scratch, rows: DataFrame, stages: list[str], s: Settings) -> DataFrame:
    """rows with median, mad, raw_high and guard of the first of the counters in stages that isn't empty; guard is that of valid."""
    used = reduce(lambda rest, c: F.when(size(F.col(c)) > 0, F.col(c)).otherwise(rest), reversed(stages[:-1]), F.col(stages[-1]))
    rows = with_spread(scratch, rows.withColumn("_used", used), "_used", "median", "mad").drop("_used")
    return rows.withColumn("raw_high", F.col("median") + s.high_mads * F.greatest(F.lit(2.0), F.col("mad"))).withColumn("guard", rank(F.col("valid"), 1 - s.seed_share))


def _low(high: Column, s: Settings) -> Column:
    return F.greatest(high * s.low_share, F.col("median") + s.low_mads * F.greatest(F.lit(2.0), F.col("mad")))


def frame_thresholds(scratch: Scratch, cells: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """Of cells' counters (keys, valid, candidates): median, mad, guard, low, high, the number of valid and stable pixels, of those in the tail, and whether they are enough."""
    rows = without_tail(scratch, added(cells, keys, ["valid", "candidates"]), "candidates", "stable", s)
    rows = _limits(scratch, rows, ["stable", "candidates", "valid"], s)
    rows = rows.withColumn("high", _clamp(F.greatest(F.col("raw_high"), F.col("guard")), F.lit(float(s.high_floor)), F.lit(float(s.high_ceiling))))
    rows = rows.withColumn("low", _clamp(_low(F.col("high"), s), F.lit(float(s.low_floor)), F.col("high") - 1))
    n = {c: size(F.col(c)) for c in ("valid", "candidates", "stable")}
    enough = n["stable"] >= F.greatest(F.lit(s.stable_pixels), F.floor(n["valid"] * s.stable_share + 0.5))
    return rows.select(*keys, "median", "mad", "guard", "low", "high", n["valid"].alias("valid_pixels"), n["stable"].alias("stable_pixels"), (n["candidates"] - n["stable"]).alias("tail_pixels"), enough.alias("enough"))


def cell_thresholds(scratch: Scratch, cells: DataFrame, keys: list[str], cell: list[str], frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For each cell (keys, cell) its median, mad, low and high, high at least the frame's and at most so much above it; frames: as frame_thresholds() gives them."""
    rows = _limits(scratch, without_tail(scratch, cells, "candidates", "stable", s), ["stable", "valid"], s).select(*keys, *cell, "median", "mad", "raw_high", "guard")
    rows = rows.join(frames.select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high")), keys)
    least = F.greatest(F.lit(float(s.high_floor)), F.col("_high"))
    most = F.least(F.lit(float(s.high_ceiling)), F.col("_high") * s.local_high)
    rows = rows.withColumn("high", _clamp(F.greatest(F.col("raw_high"), F.col("guard"), F.lit(float(s.high_floor))), least, most))
    return rows.withColumn("low", _clamp(_low(F.col("high"), s), F.greatest(F.lit(float(s.low_floor)), F.col("_low") * s.local_low), F.col("high") - 1)).drop("_low", "_high")
