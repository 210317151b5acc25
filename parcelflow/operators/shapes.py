"""Shapes of components: splitting weakly joined ones, outlines as polygons. Kernels over one component's pixels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parcelflow.operators.evidence import label
from parcelflow.sources.shipping import ship

# Limits of splitting, tolerance of outlines.
SPLIT_AREA, SPLIT_SIDE, SPLIT_DENSITY, STRONG_RATIO, STRONG_SHARE, CORE_AREA, REST_AREA = 1200, 48, 0.42, 0.82, 0.78, 24, 72
TOLERANCE = 0.012
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def split(pdf: pd.DataFrame, high: float) -> pd.DataFrame:
    """One component (pair_id, component, y, x, score) with part numbers; small residue of a split is dropped."""
    y, x = pdf["y"], pdf["x"]
    h, w = int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1
    whole = pdf.assign(part=1)
    if len(pdf) < SPLIT_AREA or min(h, w) < SPLIT_SIDE or len(pdf) / (h * w) > SPLIT_DENSITY:
        return whole
    ordered = np.sort(pdf["score"].to_numpy())
    limit = max(high * STRONG_RATIO, float(ordered[min(len(ordered) - 1, int(len(ordered) * STRONG_SHARE))]))
    strong = pdf["score"] >= limit
    cores = _large(pdf[strong], CORE_AREA)
    if cores["piece"].nunique() < 2:
        return whole
    rest = _large(pdf[~pdf.index.isin(cores.index)], REST_AREA)
    parts = pd.concat([cores.assign(kind=0), rest.assign(kind=1)])
    box = parts.groupby(["kind", "piece"]).agg(top=("y", "min"), left=("x", "min")).sort_values(["top", "left"], kind="stable")
    box["part"] = np.arange(1, len(box) + 1)
    return parts.join(box["part"], on=["kind", "piece"])[[*pdf.columns, "part"]]


def _large(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Rows of the 8-connected pieces of at least so many pixels, with their number as piece."""
    if rows.empty:
        return rows.assign(piece=pd.Series(dtype="int64"))
    y, x = (rows["y"] - rows["y"].min()).to_numpy(), (rows["x"] - rows["x"].min()).to_numpy()
    mask = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
    mask[y, x] = True
    got = rows.assign(piece=label(mask)[0][y, x])
    return got[got.groupby("piece")["piece"].transform("size") >= least]


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """Outer border pixels (x, y) of the 8-connected piece of the first set pixel, clockwise from there."""
    m = np.pad(mask.astype(bool), 1)
    start = tuple(int(v) for v in np.argwhere(m)[0])
    here, came, out, first = start, 4, [], None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            to = (here[0] + _AROUND[d][0], here[1] + _AROUND[d][1])
            if m[to]:
                break
        else:
            return [(start[1] - 1, start[0] - 1)]
        if (here, d) == first:
            return out
        first = first or (here, d)
        out.append((here[1] - 1, here[0] - 1))
        here, came = to, (d + 4) % 8


def simplified(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """Douglas-Peucker on a closed line, opened at its first point and the one farthest from that."""
    if len(points) < 4:
        return points
    p = np.array(points, dtype=float)
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    closed = np.vstack([p, p[:1]])
    keep, todo = {0, far}, [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rel = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        size = math.hypot(*line)
        off = abs(line[0] * rel[:, 1] - line[1] * rel[:, 0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[i] for i in sorted(keep)]


def polygon(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component's outline: simplified, or whole if fewer than three corners are left."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
    mask[y - y.min(), x - x.min()] = True
    line = outline(mask)
    around = sum(math.dist(a, b) for a, b in zip(line, line[1:] + line[:1], strict=True))
    corners = simplified(line, max(1.0, around * TOLERANCE))
    corners = corners if len(corners) >= 3 else line
    flat = [[int(a + x.min()), int(b + y.min())] for a, b in corners]
    return pd.DataFrame({"pair_id": [pdf["pair_id"].iloc[0]], "component": [pdf["component"].iloc[0]], "area": [len(pdf)], "polygon": [flat]})


def split_components(rows: DataFrame, high: float) -> DataFrame:
    """pair_id, component, y, x, score and part of labelled pixels."""
    ship(rows.sparkSession)
    kinds = "pair_id long, component long, y long, x long, score long"
    return rows.select("pair_id", "component", "y", "x", "score").groupBy("pair_id", "component").applyInPandas(lambda p: split(p, high), f"{kinds}, part long")


def polygons(rows: DataFrame) -> DataFrame:
    """pair_id, component, area, polygon (points x, y) of labelled pixels."""
    ship(rows.sparkSession)
    return rows.select("pair_id", "component", "y", "x").groupBy("pair_id", "component").applyInPandas(polygon, "pair_id long, component long, area long, polygon array<array<long>>")
