"""Image sources: pairs of uploaded files, data URLs, guards, decoding, masks.

Files are read by Spark's own sources. Web addresses are recognised but never fetched. Files
are decoded by the JVM (PNG, JPEG, GIF; no EXIF rotation, no WebP), masks by the codec of
``functions.png``; a large image stays one row and is cut to tiles by ``operators.tiles``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from parcelflow.functions import png
from parcelflow.sources.shipping import ship

# Limits of an upload and of an image.
MAX_BYTES, MAX_SIDE, MAX_PIXELS, ANALYSIS_SIDE = 20 * 1024 * 1024, 10_000, 24_000_000, 1400
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}
_DATA_URL = "(?is)^data:image/(png|jpe?g|webp|gif);base64,"
_DECODED = "path string, width int, height int, rgb binary, analysis_width int, analysis_height int, analysis_rgb binary"


def upload_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, old_path, current_path, status (200 or 400) and error of files <pair>/oldImage.* and <pair>/currentImage.*.

    Only paths and lengths are read. Files of another type or over the limit don't count; of
    several of one kind the first path counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.regexp_extract("path", r"/(oldImage|currentImage)\.[^/.]+$", 1)
    known = F.lower(F.regexp_extract("path", r"\.([^/.]+)$", 1)).isin(*MIME)
    usable = known & (F.col("length") <= MAX_BYTES)
    rows = files.where(kind != "").groupBy(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("pair_id")).agg(
        F.min(F.when((kind == "oldImage") & usable, F.col("path"))).alias("old_path"), F.min(F.when((kind == "currentImage") & usable, F.col("path"))).alias("current_path"),
        F.bool_or(~known).alias("_type"), F.bool_or(F.col("length") > MAX_BYTES).alias("_size"),
    )
    error = F.when(F.col("_type"), "Use PNG, JPEG, WebP, or GIF images.").when(F.col("_size"), "File too large").when(F.col("old_path").isNull() | F.col("current_path").isNull(), "Both oldImage and currentImage are required.")
    return rows.select("pair_id", "old_path", "current_path", F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"))


def is_image_source(url: Column) -> Column:
    """A web address, or a base64 data URL of a known image type; null: false."""
    return F.coalesce(url.rlike("(?i)^https?://") | url.rlike(_DATA_URL), F.lit(False))


def data_url_bytes(url: Column) -> Column:
    """The bytes of an image data URL; null for all else, web addresses included."""
    return F.when(url.rlike(_DATA_URL), F.try_to_binary(F.regexp_replace(url, "(?s)^[^,]*,", ""), F.lit("base64")))


def extension(mime: Column) -> Column:
    return F.when(mime == "image/jpeg", "jpg").when(mime == "image/png", "png").when(mime == "image/webp", "webp").when(mime == "image/gif", "gif").otherwise("bin")


def within_limits(width: Column, height: Column) -> Column:
    w, h = width.cast("long"), height.cast("long")
    return F.coalesce((w > 0) & (h > 0) & (w <= MAX_SIDE) & (h <= MAX_SIDE) & (w * h <= MAX_PIXELS), F.lit(False))


def resized(rgb: np.ndarray, side: int) -> np.ndarray:
    """Shrunk to fit a square of side, by means over areas; smaller images stay as they are."""
    h, w = rgb.shape[:2]
    scale = side / max(h, w)
    if scale >= 1:
        return rgb
    out = rgb.astype(np.float64)
    for axis, n in ((0, max(1, round(h * scale))), (1, max(1, round(w * scale)))):
        size = out.shape[axis]
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        at = np.linspace(0, size, n + 1)
        low = np.minimum(at.astype(int), size - 1)
        shape = [-1 if k == axis else 1 for k in range(3)]
        sums = total.take(low, axis) + (at - low).reshape(shape) * (total.take(low + 1, axis) - total.take(low, axis))
        out = np.diff(sums, axis=axis) * n / size
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def _normalized(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a row is a whole image
                raw = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(raw, 3, axis=2) if r["nChannels"] == 1 else raw[:, :, 2::-1]
                small = resized(rgb, side)
                yield pa.RecordBatch.from_pylist([{
                    "path": r["origin"], "width": r["width"], "height": r["height"], "rgb": np.ascontiguousarray(rgb).tobytes(),
                    "analysis_width": small.shape[1], "analysis_height": small.shape[0], "analysis_rgb": np.ascontiguousarray(small).tobytes(),
                }], schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("analysis_width", pa.int32()), ("analysis_height", pa.int32()), ("analysis_rgb", pa.binary())]))

    return run


def decoded(spark: SparkSession, path: str, side: int = ANALYSIS_SIDE) -> DataFrame:
    """path, native size and RGB bytes, and the same shrunk for analysis, of each image within the limits."""
    ship(spark)
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").where(within_limits(F.col("width"), F.col("height")))
    return rows.select("origin", "width", "height", "nChannels", "data").mapInArrow(_normalized(side), _DECODED)


def over_limits(spark: SparkSession, path: str) -> DataFrame:
    """A result row, state RESOURCE_LIMIT_EXCEEDED, for each image that the guard refuses."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height")
    return rows.where(~within_limits(F.col("width"), F.col("height"))).select(F.col("origin").alias("path"), "width", "height", F.lit("RESOURCE_LIMIT_EXCEEDED").alias("state"))


@F.pandas_udf(t.StructType([t.StructField("width", t.IntegerType()), t.StructField("height", t.IntegerType()), t.StructField("mask", t.BinaryType())]))
def _mask(data: pd.Series) -> pd.DataFrame:
    """A PNG's grey value per pixel, 0 or not: bytes 0 or 255. Null or no such PNG: null."""
    rows = []
    for raw in data:
        try:
            a = png.decode(raw) if raw is not None else None
        except ValueError:
            a = None
        rows.append((None, None, None) if a is None else (a.shape[1], a.shape[0], np.where(a.max(axis=2) > 0, 255, 0).astype(np.uint8).tobytes()))
    return pd.DataFrame(rows, columns=["width", "height", "mask"]).astype({"width": "Int32", "height": "Int32"})


def masks(rows: DataFrame, column: str) -> DataFrame:
    """rows with width, height and mask of the PNG in a binary column."""
    ship(rows.sparkSession)
    return rows.withColumn("_m", _mask(F.col(column))).select(*rows.columns, "_m.*")
