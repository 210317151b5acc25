"""Registration of image pairs: viewport, masks, warp, residuals, reliability.

The transform comes as a column (nine numbers, row-major, current to old), found by whatever
matcher ran before; here it is applied, measured and graded. A row is one pair, bounded by
the guard of the image source; kernels are numpy, the gates are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions.boxes import clamp
from parcelflow.sources.shipping import ship

# Overlays of the map's interface, as shares of the frame: left, top, width, height.
UI_BOXES = ((0, 0, 1, 0.1), (0, 0.045, 0.055, 0.24), (0.955, 0.075, 0.045, 0.72), (0, 0.955, 1, 0.045), (0, 0.9, 0.22, 0.055))
# Limits of a reliable registration.
GRID, TOLERANCE, EDGE = 4, 2, 42
MIN_MATCHES, MIN_INLIERS, MIN_RATIO, MIN_COVERAGE, MIN_OVERLAP = 12, 18, 0.23, 0.08, 0.62
MAX_MEDIAN, MAX_P95, MAX_EDGE, MAX_EDGE_CHANGED, MAX_LOCAL = 3, 7, 0.42, 0.5, 0.62
MIN_SCALE, MAX_SCALE = 0.7, 1.45
MIN_FEATURES = 0.5
SANE_AREA, SANE_SIDES = (0.35, 2.8), (0.45, 2.2)

_OUT = (
    "pair_id long, width int, height int, warped binary, valid binary, residual binary, edge_residual binary, valid_overlap double, edge_alignment double, "
    "scale_ratio double, sane boolean, parallax boolean, grid array<struct<row:int,column:int,valid_pixels:long,edge_alignment:double>>"
)


def _trailing(dark: np.ndarray, least: float, low: float, high: float, n: int) -> int:
    """Where the run of dark lines at the end begins; n if it isn't of a plausible length.

    dark: of the lines from the first candidate to the last. A run shorter than least is
    forgotten at the next bright line; a longer one ends the search there.
    """
    bright = np.flatnonzero(~dark[::-1])
    start, run = n, 0
    for stop in [*bright.tolist(), len(dark)]:
        if stop > run:
            start = n - stop
            if stop == len(dark) or stop - run >= least:
                break
        start, run = n, stop + 1
    return n if n - start > high * n or n - start < low * n else start


def _dark(rgb: np.ndarray, luma: float, chroma: int) -> np.ndarray:
    a = rgb.astype(np.float64)
    return (a @ np.array([0.299, 0.587, 0.114]) < luma) & (a.max(axis=-1) - a.min(axis=-1) < chroma)


def viewport(rgb: np.ndarray) -> tuple[int, int]:
    """Width and height of the map without a dark panel at the right and a dark bar below."""
    h, w = rgb.shape[:2]
    first, side = int(w * 0.88), rgb[int(h * 0.06) : int(h * 0.94) : 3]
    columns = _dark(side[:, first:], 82, 42)
    right = _trailing(columns.mean(axis=0) > 0.56, max(8, w * 0.012), 0.01, 0.12, w) if columns.size else w
    rows = _dark(rgb[int(h * 0.92) :, int(w * 0.03) : right : 3], 76, 48)
    return right, _trailing(rows.mean(axis=1) > 0.5, max(6, h * 0.008), 0.006, 0.08, h) if rows.size else h


def feature_mask(w: int, h: int, right: int | None = None, bottom: int | None = None) -> np.ndarray:
    """Pixels of the viewport (by default of the frame) that no overlay covers; boxes' far edges are covered too."""
    mask = np.zeros((h, w), bool)
    mask[: h if bottom is None else bottom, : w if right is None else right] = True
    for x, y, dx, dy in UI_BOXES:
        left, top = w * x, h * y
        mask[int(np.floor(top)) : int(np.ceil(top + h * dy)) + 1, int(np.floor(left)) : int(np.ceil(left + w * dx)) + 1] = False
    return mask


def scaled(matrix: np.ndarray, source: tuple[float, float], target: tuple[float, float]) -> np.ndarray:
    """A transform between shrunk images as one between native images; source, target: shrunk / native in x, y."""
    return np.diag([1 / target[0], 1 / target[1], 1]) @ matrix @ np.diag([source[0], source[1], 1])


def warped(planes: np.ndarray, mask: np.ndarray, matrix: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """planes (bilinear, zero outside) and mask (nearest) as seen in the target frame; by the inverse transform of its pixels."""
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    sx, sy, d = np.einsum("ij,jhw->ihw", np.linalg.inv(matrix), np.stack([x, y, np.ones_like(x)]))
    fine = d != 0
    limit = 4.0 * max(planes.shape[:2]) + 4
    sx, sy = (np.where(fine, np.clip(v / np.where(fine, d, 1), -limit, limit), -limit) for v in (sx, sy))
    rows, cols = planes.shape[:2]
    padded = np.zeros((rows + 2, cols + 2, planes.shape[2]))
    padded[1:-1, 1:-1] = planes
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    at = lambda j, i: padded[np.clip(j + 1, 0, rows + 1), np.clip(i + 1, 0, cols + 1)]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    nx, ny = np.floor(sx + 0.5).astype(np.int64), np.floor(sy + 0.5).astype(np.int64)
    inside = (nx >= 0) & (ny >= 0) & (nx < cols) & (ny < rows)
    return np.floor(out + 0.5).astype(np.uint8), inside & mask[np.clip(ny, 0, rows - 1), np.clip(nx, 0, cols - 1)]


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.int64)


def gradient(g: np.ndarray) -> np.ndarray:
    """Sobel magnitude over four, at most 255; zero at the border."""
    out = np.zeros(g.shape, np.int64)
    if min(g.shape) > 2:
        across = g[:, 2:] - g[:, :-2]
        down = g[2:] - g[:-2]
        gx, gy = across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
        out[1:-1, 1:-1] = np.minimum(255, np.floor(np.hypot(gx, gy) / 4 + 0.5))
    return out


def _shifts(a: np.ndarray, r: int, outside: int | bool) -> Iterator[np.ndarray]:
    p = np.pad(a, r, constant_values=outside)
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            yield p[dy : dy + a.shape[0], dx : dx + a.shape[1]]


def adjacent(cells: set[tuple[int, int]]) -> bool:
    """Whether two of the grid's cells share a side."""
    return any((r + 1, c) in cells or (r, c + 1) in cells for r, c in cells)


def residuals(reference: np.ndarray, other: np.ndarray, valid: np.ndarray) -> dict:
    """What is left between two aligned images where both are valid: planes, shares, and a grid of shares.

    An edge counts as unmatched if the other image has none within TOLERANCE pixels; grey
    differences are to the nearest value within the same window, both ways.
    """
    h, w = valid.shape
    a, b = gray(reference), gray(other)
    ea, eb = gradient(a) >= EDGE, gradient(b) >= EDGE

    def near(edge: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce(list(_shifts(edge & valid, TOLERANCE, False)))

    def least(source: np.ndarray, target: np.ndarray) -> np.ndarray:
        best = np.full(source.shape, 255)
        for v in _shifts(np.where(valid, target, 1 << 20), TOLERANCE, 1 << 20):
            np.minimum(best, np.abs(source - v), out=best)
        return best

    edge = (ea | eb) & valid
    lone = ((ea & ~near(eb)) | (eb & ~near(ea))) & valid
    tone = np.floor((least(a, b) + least(b, a)) / 2 + 0.5)
    residual = np.where(valid, np.maximum(np.where(lone, 255, 0), np.minimum(255, tone * 3)), 0).astype(np.uint8)
    cell = np.minimum(GRID - 1, np.arange(h) * GRID // max(1, h))[:, None] * GRID + np.minimum(GRID - 1, np.arange(w) * GRID // max(1, w))[None, :]
    count = lambda m: np.bincount(cell[m], minlength=GRID * GRID)
    n_valid, n_edge, n_lone = count(valid), count(edge), count(lone)
    share = np.round(n_lone / np.maximum(1, n_edge), 3)
    bad = np.flatnonzero((n_valid > w * h / GRID**2 * 0.25) & (share > MAX_LOCAL))
    return {
        "residual": residual,
        "edge_residual": np.where(lone, 255, 0).astype(np.uint8),
        "valid_overlap": float(valid.sum() / max(1, w * h)),
        "edge_alignment": float(lone.sum() / max(1, edge.sum())),
        "grid": [{"row": k // GRID, "column": k % GRID, "valid_pixels": int(n_valid[k]), "edge_alignment": float(share[k])} for k in range(GRID * GRID)],
        "parallax": adjacent({(k // GRID, k % GRID) for k in bad.tolist()}) or len(bad) >= max(3, GRID * GRID // 5),
    }


def _corners(matrix: np.ndarray, source: tuple[int, int]) -> np.ndarray:
    """x and y of the source frame's corners in the target, clockwise from the top left one; a corner at infinity isn't finite."""
    w, h = source
    p = matrix @ np.array([[0, w, w, 0], [0, 0, h, h], [1, 1, 1, 1]], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return p[:2] / p[2]


def sane(matrix: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> bool:
    """Whether the frame keeps a plausible area, and its opposite sides plausible proportions."""
    p = _corners(matrix, source)
    if not np.isfinite(p).all():
        return False
    top, right, bottom, left = np.hypot(*(np.roll(p, -1, axis=1) - p))
    between = lambda v, least, most: least < v < most
    return bool(min(right, bottom) > 0 and between(scale_ratio(matrix, source, target), *SANE_AREA) and between(top / bottom, *SANE_SIDES) and between(left / right, *SANE_SIDES))


def scale_ratio(matrix: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> float:
    """Area of the source frame in the target, over the target's."""
    x, y = _corners(matrix, source)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2 / max(1, target[0] * target[1]))


def align(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, old_rgb, old_width, old_height, current_rgb, current_width, current_height, homography) aligned to the old frame.

    A null, incomplete or singular homography gives planes of zeros, a residual of 1 and no
    overlap: a failed registration that grade() refuses.
    """

    def one(r) -> tuple:
        w, h = int(r.old_width), int(r.old_height)
        m = np.asarray([] if r.homography is None else r.homography, float)
        if m.size != 9 or not np.isfinite(m).all() or abs(np.linalg.det(m.reshape(3, 3))) < 1e-12:
            zero = bytes(w * h)
            return r.pair_id, w, h, bytes(w * h * 3), zero, zero, zero, 0.0, 1.0, 0.0, False, False, []
        m = m.reshape(3, 3)
        cw, ch = int(r.current_width), int(r.current_height)
        old, current = np.frombuffer(r.old_rgb, np.uint8).reshape(h, w, 3), np.frombuffer(r.current_rgb, np.uint8).reshape(ch, cw, 3)
        image, valid = warped(current, feature_mask(cw, ch), m, w, h)
        valid &= feature_mask(w, h)
        got = residuals(old, image, valid)
        return (
            r.pair_id, w, h, image.tobytes(), np.where(valid, 255, 0).astype(np.uint8).tobytes(), got["residual"].tobytes(), got["edge_residual"].tobytes(),
            got["valid_overlap"], got["edge_alignment"], scale_ratio(m, (cw, ch), (w, h)), sane(m, (cw, ch), (w, h)), got["parallax"], got["grid"],
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pair_id", "width", "height", "warped", "valid", "residual", "edge_residual", "valid_overlap", "edge_alignment", "scale_ratio", "sane", "parallax", "grid"]
        for pdf in parts:
            for r in pdf.itertuples():  # a row is a pair of whole images
                yield pd.DataFrame([one(r)], columns=names)

    ship(pairs.sparkSession)
    columns = ["pair_id", "old_rgb", "old_width", "old_height", "current_rgb", "current_width", "current_height", "homography"]
    return pairs.select(*columns).mapInPandas(run, _OUT)


def promoted(pairs: DataFrame) -> DataFrame:
    """align() of native images by the homography between shrunk ones (old_scale, current_scale: shrunk / native, alike in x and y)."""
    h = F.col("homography")
    a, b = F.col("current_scale"), F.col("old_scale")
    # a native point shrinks by a, moves by the homography, and grows by 1 / b
    native = F.array(h[0] * a / b, h[1] * a / b, h[2] / b, h[3] * a / b, h[4] * a / b, h[5] / b, h[6] * a, h[7] * a, h[8])
    return align(pairs.withColumn("homography", F.when(F.size("homography") == 9, native)))


def swapped(pairs: DataFrame) -> DataFrame:
    """Pairs with their sides exchanged: to register the old image to the current one instead."""
    names = {f"{a}_{c}": f"{b}_{c}" for a, b in (("old", "current"), ("current", "old")) for c in ("rgb", "width", "height")}
    return pairs.select(*(F.col(names.get(c, c)).alias(c) for c in pairs.columns))


def feature_confidence(inliers: Column, ratio: Column, coverage: Column) -> Column:
    part = lambda v, full: F.least(F.lit(1.0), v / full)
    return part(inliers, 55) * 0.42 + part(ratio, 0.55) * 0.33 + part(coverage, 0.35) * 0.25


def grade(rows: DataFrame) -> DataFrame:
    """rows with reliable, confidence and failed (names of the checks that did not hold).

    Columns: matches, inliers, inlier_ratio, coverage, median_error, p95_error, and those of
    align(). A null measure fails its check and counts as none.
    """
    c = F.col
    ok = lambda x: F.coalesce(x, F.lit(False))
    steady = (c("edge_alignment") <= MAX_EDGE_CHANGED) & (c("median_error") <= 1) & (c("p95_error") <= 2) & (c("inlier_ratio") >= 0.5)
    feature = feature_confidence(*(F.coalesce(c(k), F.lit(0.0)) for k in ("inliers", "inlier_ratio", "coverage")))
    checks = {
        "features": (c("matches") >= MIN_MATCHES) & (c("inliers") >= MIN_INLIERS) & (c("inlier_ratio") >= MIN_RATIO) & (c("coverage") >= MIN_COVERAGE) & (feature >= MIN_FEATURES) & c("sane"),
        "reprojection": (c("median_error") <= MAX_MEDIAN) & (c("p95_error") <= MAX_P95),
        "residual": (c("edge_alignment") <= MAX_EDGE) | steady,
        "overlap": c("valid_overlap") >= MIN_OVERLAP,
        "scale": c("scale_ratio").between(MIN_SCALE, MAX_SCALE),
    }
    failed = F.filter(F.array(*(F.when(~ok(v), F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    quality = lambda v, full: clamp(1 - v / full, 0.0, 1.0)
    n = lambda k: F.coalesce(c(k), F.lit(0.0))
    worst = lambda k, v: F.coalesce(c(k), F.lit(v))
    confidence = (
        feature * 0.55 + quality(worst("edge_alignment", 1.0), MAX_EDGE) * 0.25
        + quality(worst("p95_error", 1e9), MAX_P95 * 1.5) * 0.15 + clamp(n("valid_overlap") / MIN_OVERLAP, 0.0, 1.0) * 0.05
    )
    return rows.withColumns({"failed": failed, "confidence": clamp(confidence, 0.0, 1.0)}).withColumn("reliable", F.size("failed") == 0)
