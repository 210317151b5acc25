"""Annotations of image pairs: JSON files with reviewed positives, negatives and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators.runs import of_rings

_AREA = "id: string, reason: string, polygon: array<array<double>>, maskPath: string"
SCHEMA = (
    "schemaVersion string, annotationVersion string, id string, images struct<oldPath: string, currentPath: string, oldFixtureId: string, currentFixtureId: string>, "
    "capture struct<provider: string, sensor: string, oldDate: string, currentDate: string, metersPerPixel: double, crs: string, provenance: string>, "
    "split struct<partition: string, geographyGroup: string, dateGroup: string, providerGroup: string>, "
    "positives array<struct<id: string, changeClass: string, geometryQuality: string, reviewer: string, annotationVersion: string, polygon: array<array<double>>, maskPath: string, uncertain: boolean, notes: string>>, "
    f"ignoredOrUncertain array<struct<{_AREA}>>, reviewedNegativeRegions array<struct<{_AREA}>>, unreviewedPolicy string"
)


def read(spark: SparkSession, path: str, images: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """One row for each file (an object that may span lines); images: paths that replace those of the files."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    for name, to in zip(("oldPath", "currentPath"), images, strict=True):
        if to:
            rows = rows.withColumn("images", F.col("images").withField(name, F.lit(to)))
    return rows


def positives(annotations: DataFrame) -> DataFrame:
    """Reviewed objects that are certain: id of the pair, object_id, change_class, ring (x, y), mask_path."""
    rows = annotations.select("id", F.explode("positives").alias("p")).where(~F.coalesce(F.col("p.uncertain"), F.lit(False)))
    return rows.select("id", F.col("p.id").alias("object_id"), F.col("p.changeClass").alias("change_class"), ring(F.col("p.polygon")).alias("ring"), F.col("p.maskPath").alias("mask_path"))


def ring(polygon):
    return F.transform(polygon, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def region_ring(polygon, left, top, width, height):
    """A region's polygon, or without one its box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(corner(left, top), corner(left + width, top), corner(left + width, top + height), corner(left, top + height))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, polygon).otherwise(box)


def rasterized(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, y, x of pixels whose centres lie in ring (x, y), row by row from its edges; fewer than three points hold nothing. keys name a ring."""
    lines = of_rings(rows, keys, width, height)
    return lines.select(*keys, "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
