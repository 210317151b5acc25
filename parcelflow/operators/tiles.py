"""Stencils over large images by tiles with a halo: cut, apply, keep the cores, stitch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.sources.shipping import ship

CORE = 768
_TILE = "image_id long, width int, height int, top int, left int, rows int, cols int, pad_top int, pad_left int, tile_rows int, tile_cols int, data binary"
_CORE = "image_id long, width int, height int, top int, left int, rows int, cols int, data binary"


def halo(*radii: int) -> int:
    """Pixels around a core: those that all stencils together reach, at least 32."""
    return max(32, sum(radii) + 2)


def cut(images: DataFrame, core: int, margin: int) -> DataFrame:
    """Tiles of one-byte planes (image_id, width, height, data); one row each, so that an image's tiles can spread."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                plane = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                for top in range(0, r.height, core):
                    for left in range(0, r.width, core):
                        y, x = max(0, top - margin), max(0, left - margin)
                        rows, cols = min(core, r.height - top), min(core, r.width - left)
                        t = np.ascontiguousarray(plane[y : top + rows + margin, x : left + cols + margin])
                        yield pd.DataFrame([(r.image_id, r.width, r.height, top, left, rows, cols, top - y, left - x, *t.shape, t.tobytes())], columns=[c.split()[0] for c in _TILE.split(", ")])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, _TILE)


def apply(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Cores of kernel(tile); the kernel keeps a tile's shape."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cores = []
            for r in pdf.itertuples():
                got = kernel(np.frombuffer(r.data, np.uint8).reshape(r.tile_rows, r.tile_cols))
                cores.append(np.ascontiguousarray(got[r.pad_top : r.pad_top + r.rows, r.pad_left : r.pad_left + r.cols]).astype(np.uint8).tobytes())
            yield pdf[[c.split()[0] for c in _CORE.split(", ")[:-1]]].assign(data=cores)

    ship(tiles.sparkSession)
    spread = tiles.repartition("image_id", "top", "left")
    return spread.mapInPandas(run, _CORE)


def stitch(cores: DataFrame) -> DataFrame:
    """image_id, width, height, data of whole planes. An image is bounded by the guard of the image source."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        out = np.zeros((h, w), np.uint8)
        for r in pdf.itertuples():
            out[r.top : r.top + r.rows, r.left : r.left + r.cols] = np.frombuffer(r.data, np.uint8).reshape(r.rows, r.cols)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [w], "height": [h], "data": [out.tobytes()]})

    return cores.groupBy("image_id").applyInPandas(whole, "image_id long, width int, height int, data binary")


def tiled(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], margin: int, core: int = CORE) -> DataFrame:
    return stitch(apply(cut(images, core, margin), kernel))


def grid_labels(images: DataFrame, cells: int = 10) -> DataFrame:
    """image_id, label (A0 to J9), x, y of the corners of a coordinate grid."""
    n = F.sequence(F.lit(0), F.lit(cells - 1))
    rows = images.select("image_id", "width", "height", F.explode(n).alias("row")).select("*", F.explode(n).alias("column"))
    label = F.concat(F.char(65 + F.col("column")), F.col("row").cast("string"))
    return rows.select("image_id", label.alias("label"), (F.col("width") * F.col("column") / cells).alias("x"), (F.col("height") * F.col("row") / cells).alias("y"))
