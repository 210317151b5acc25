"""Overlays of regions as GeoJSON in pixels, one feature collection a pair and kind, and placeholder drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of the states.
STYLES = {"accepted": ("#ef4444", False), "needs_review": ("#f59e0b", True), "rejected": ("#94a3b8", True), "candidate": ("#38bdf8", False)}


def feature(name: Column, ring: Column, color: str, dashed: bool) -> Column:
    """A polygon with its label; the ring is closed by its first point."""
    point = lambda p: F.array(p["x"], p["y"])
    closed = F.transform(F.concat(ring, F.slice(ring, 1, 1)), point)
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"), F.struct(name.alias("label"), F.lit(color).alias("color"), F.lit(dashed).alias("dashed")).alias("properties"))


def box_ring(left: Column, top: Column, width: Column, height: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(left, top), at(left + width, top), at(left + width, top + height), at(left, top + height))


def overlay(regions: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """pair_id, geojson of regions (region_id, state, geometry_type, ring, left, top, width, height) in these states, in the order of ids.

    Regions without an outline, or whose place is a coarse box, are drawn as boxes. Pairs without
    such a region have no row. A pair's regions are one text, so they come together.
    """
    ring = F.when((F.coalesce(F.size("ring"), F.lit(0)) >= 3) & (F.col("geometry_type") != "frontier_bbox"), F.col("ring")).otherwise(box_ring(*(F.col(c) for c in ("left", "top", "width", "height"))))
    shape = F.lit(None)
    for s in states:
        shape = F.when(F.col("state") == s, feature(F.col("region_id"), ring, *STYLES[s])).otherwise(shape)
    rows = regions.where(F.col("state").isin(*states)).select("pair_id", F.struct("region_id", shape.alias("f")).alias("r"))
    every = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["f"])
    return rows.groupBy("pair_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), every.alias("features"))).alias("geojson"))


def accepted(regions: DataFrame) -> DataFrame:
    return overlay(regions, ("accepted",))


def review(regions: DataFrame) -> DataFrame:
    return overlay(regions, ("needs_review",))


def rejected(regions: DataFrame) -> DataFrame:
    return overlay(regions, ("rejected",))


def combined(regions: DataFrame) -> DataFrame:
    return overlay(regions, ("accepted", "needs_review"))


def candidates(rows: DataFrame) -> DataFrame:
    """Boxes of all candidates, whatever their state."""
    return overlay(rows.withColumn("state", F.lit("candidate")).withColumn("geometry_type", F.lit("frontier_bbox")), ("candidate",))


def keypoints(points: DataFrame) -> DataFrame:
    """pair_id, geojson of matched points (pair_id, x, y, inlier)."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct("inlier").alias("properties"))
    rows = points.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", f.alias("f")))).alias("p"))
    return rows.select("pair_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("p", lambda x: x["f"]).alias("features"))).alias("geojson"))


def placeholder(label: Column, after: Column) -> Column:
    """An SVG data URL that stands for an image in demo data; it never counts as evidence."""
    body = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="640" height="420"><rect width="640" height="420" fill="#d9e4d2"/>'),
        F.when(after, F.lit('<rect x="300" y="180" width="90" height="70" fill="#b45309"/>')).otherwise(""), F.lit('<text x="20" y="40">'),
        F.replace(F.replace(F.coalesce(label, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</text></svg>"),
    )
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(body.cast("binary")))
