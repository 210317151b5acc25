"""Crops of images, planes and masks as PNG data URLs, one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parcelflow.functions.png import data_url, encode
from parcelflow.sources.shipping import ship

_KIND = "pair_id long, id string, url string"


def _run(channels: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.frame_height, r.frame_width, channels)
                part = a[max(0, r.top) : max(0, r.top + r.height), max(0, r.left) : max(0, r.left + r.width)]
                out.append(data_url(encode(part if channels == 3 else part[..., 0])) if part.size else None)
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "id": pdf["id"], "url": out})

    return run


_COLUMNS = ("pair_id", "id", "frame_width", "frame_height", "left", "top", "width", "height", "data")


def image_crops(rows: DataFrame) -> DataFrame:
    """pair_id, id, url of boxes (left, top, width, height) of RGB images (data, frame_width, frame_height); null for a box outside."""
    ship(rows.sparkSession)
    return rows.select(*_COLUMNS).mapInPandas(_run(3), _KIND)


def plane_crops(rows: DataFrame) -> DataFrame:
    """The same of planes of bytes."""
    ship(rows.sparkSession)
    return rows.select(*_COLUMNS).mapInPandas(_run(1), _KIND)


def mask_crops(rows: DataFrame) -> DataFrame:
    """Supports (bytes 0 or 1 of a box left, top, width, height) pasted into their crop's frame (crop_left, crop_top, crop_width, crop_height)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                frame = np.zeros((r.crop_height, r.crop_width), np.uint8)
                y, x = np.nonzero(np.frombuffer(r.support, np.uint8).reshape(r.height, r.width))
                y, x = y + r.top - r.crop_top, x + r.left - r.crop_left
                ok = (y >= 0) & (x >= 0) & (y < r.crop_height) & (x < r.crop_width)
                frame[y[ok], x[ok]] = 255
                out.append(data_url(encode(frame)))
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "id": pdf["id"], "url": out})

    ship(rows.sparkSession)
    return rows.select("pair_id", "id", "left", "top", "width", "height", "crop_left", "crop_top", "crop_width", "crop_height", "support").mapInPandas(run, _KIND)
