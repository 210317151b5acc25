"""Evidence of change between two aligned images: kernels over planes of bytes, vectorised by shifts and integral images.

A kernel takes whole numpy planes and a mask of valid pixels (bool), gives 0 where nothing is
valid, and rounds halves up. None reaches farther than its radius, so tiles with a halo
(operators.tiles) give the same planes as whole images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from parcelflow.operators.registration import gradient, gray
from parcelflow.operators.settings import Settings


def near(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def _sums(plane: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of radius r, clipped at the edges."""
    total = np.pad(plane.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = plane.shape
    y, x = np.arange(h), np.arange(w)
    y0, y1, x0, x1 = np.maximum(y - r, 0)[:, None], np.minimum(y + r + 1, h)[:, None], np.maximum(x - r, 0), np.minimum(x + r + 1, w)
    return total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0]


def box_mean(plane: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Rounded mean of valid pixels around each valid pixel."""
    return np.where(valid, near(_sums(np.where(valid, plane, 0), r) / np.maximum(1, _sums(valid, r))), 0)


def _around(shape: tuple[int, int], r: int) -> Iterator[tuple[tuple[slice, slice], tuple[slice, slice]]]:
    """For each offset of the square: where pixels are, and where their neighbours are."""
    h, w = shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if abs(dy) < h and abs(dx) < w:
                own = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
                yield own, (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))


def directed(reference: np.ndarray, current: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Least difference of each current pixel to valid reference pixels around it; of colours the mean over channels."""
    best = np.full(valid.shape, 255.0)
    for own, other in _around(valid.shape, r):
        d = np.abs(current[own] - reference[other].astype(np.float64))
        d = d.mean(axis=2) if d.ndim == 3 else d
        best[own] = np.where(valid[other], np.minimum(best[own], d), best[own])
    return np.where(valid, near(best), 0)


def symmetric(reference: np.ndarray, current: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Both directions: the larger counts for six tenths, their mean for the rest."""
    a, b = directed(reference, current, valid, r), directed(current, reference, valid, r)
    return np.where(valid, near(0.6 * np.maximum(a, b) + 0.2 * (a + b)), 0)


def color(reference: np.ndarray, current: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Symmetric residual of colours, lowered where the neighbours don't agree."""
    s = symmetric(reference, current, valid, r)
    return np.where(valid, near(np.maximum(0.82 * s, 0.68 * s + 0.32 * box_mean(s, valid, 1))), 0)


def least(plane: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Least valid value around each valid pixel."""
    out = plane.astype(np.float64).copy()
    for own, other in _around(valid.shape, r):
        out[own] = np.where(valid[other], np.minimum(out[own], plane[other]), out[own])
    return np.where(valid, out, 0) if r else out


def ssim(reference: np.ndarray, current: np.ndarray, valid: np.ndarray, r: int) -> np.ndarray:
    """Residual of structural similarity over squares, 0 to 255."""
    a, b = reference.astype(np.float64), current.astype(np.float64)
    n = np.maximum(1, _sums(np.ones(a.shape), r))
    ma, mb = _sums(a, r) / n, _sums(b, r) / n
    va, vb = np.maximum(0, _sums(a * a, r) / n - ma * ma), np.maximum(0, _sums(b * b, r) / n - mb * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    value = (2 * ma * mb + c1) * (2 * (_sums(a * b, r) / n - ma * mb) + c2) / np.maximum(np.finfo(float).eps, (ma * ma + mb * mb + c1) * (va + vb + c2))
    return np.where(valid, near(np.clip((1 - value) / 1.2 * 255, 0, 255)), 0)


def structural(reference: np.ndarray, current: np.ndarray, valid: np.ndarray, r: int, s: Settings = Settings()) -> np.ndarray:
    """Similarity, patch means and texture, all tolerant of displacements up to r."""
    pa, pb = box_mean(reference, valid, s.ssim_radius), box_mean(current, valid, s.ssim_radius)
    ta, tb = np.where(valid, np.abs(reference - pa), 0), np.where(valid, np.abs(current - pb), 0)
    patch, texture = symmetric(pa, pb, valid, r), symmetric(ta, tb, valid, r)
    value = 0.5 * least(ssim(reference, current, valid, s.ssim_radius), valid, r) + 0.35 * np.minimum(255, 3 * patch) + 0.15 * np.minimum(255, 3 * texture)
    return np.where(valid, near(np.clip(value, 0, 255)), 0)


def multiscale(fine: np.ndarray, valid: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Fine structure, raised where a wider square agrees."""
    return np.where(valid, np.minimum(255, near(np.maximum(fine, 0.72 * fine + 0.34 * box_mean(fine, valid, s.multiscale)))), 0)


def removed(reference: np.ndarray, current: np.ndarray, edges: tuple[np.ndarray, np.ndarray], structure: np.ndarray, valid: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Evidence that a structure of the reference is gone: edges and contrast lost together."""
    r = max(3, s.multiscale)
    ma, mb = box_mean(reference, valid, r), box_mean(current, valid, r)
    edge = np.maximum(0, box_mean(edges[0], valid, 3) - box_mean(edges[1], valid, 3))
    contrast = np.maximum(0, np.abs(reference - ma) - np.abs(current - mb))
    coherent = np.clip((edge / 18 + contrast / 16) / 2, 0, 1)
    return np.where(valid, near(np.clip((2.4 * edge + 1.9 * contrast + 0.45 * np.abs(ma - mb) + 0.12 * structure) * coherent, 0, 255)), 0)


def combined(c: np.ndarray, st: np.ndarray, t: np.ndarray, m: np.ndarray, valid: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """One score of colour, structure, texture and removal."""
    c, st, t, m = np.clip(c / 64, 0, 1), st / 255, np.clip(t / 96, 0, 1), m / 255
    p = (c * s.color + st * s.structure + t * s.texture) / max(0.01, s.color + s.structure + s.texture)
    weak, thin = (c < 0.18) & (st < 0.22), (t > 0.55) & (c < 0.25) & (st < 0.3)
    p = np.where(weak, p * 0.18, np.where(thin, p * 0.45, p))
    gone = (m >= 0.28) & (st >= 0.18)
    p = np.where(gone, np.maximum(p, m * (0.42 + s.removal) + 0.12 * st + 0.04 * t), p)
    return np.where(valid, near(255 * np.clip(p, 0, 1)), 0)


def direct(reference: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Largest difference over the channels."""
    return np.abs(reference.astype(np.int64) - current).max(axis=2)


def halo(displacement: int, s: Settings = Settings()) -> int:
    """Pixels around a tile's core that the kernels reach."""
    return max(s.tile_overlap, s.ssim_radius + displacement + s.multiscale + 2)


PLANES = ("color", "structure", "edge", "removal", "before_gradient", "after_gradient")


def tile(before: np.ndarray, after: np.ndarray, valid: np.ndarray, displacement: int, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """All planes of one tile of RGB images."""
    a, b = gray(before), gray(after)
    ga, gb = gradient(a), gradient(b)
    structure = multiscale(structural(a, b, valid, displacement, s), valid, s)
    return {
        "color": color(before, after, valid, displacement), "structure": structure, "edge": symmetric(ga, gb, valid, displacement),
        "removal": removed(a, b, (ga, gb), structure, valid, s), "before_gradient": ga, "after_gradient": gb,
    }


def planes(before: np.ndarray, after: np.ndarray, valid: np.ndarray, displacement: int, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """All planes of a pair by tiles with a halo, stitched from their cores."""
    h, w = valid.shape
    out = {k: np.zeros((h, w)) for k in PLANES}
    m = halo(displacement, s)
    for y in range(0, h, s.tile_size):
        for x in range(0, w, s.tile_size):
            box = slice(max(0, y - m), min(h, y + s.tile_size + m)), slice(max(0, x - m), min(w, x + s.tile_size + m))
            core = slice(y, min(h, y + s.tile_size)), slice(x, min(w, x + s.tile_size))
            inner = tuple(slice(c.start - b.start, c.stop - b.start) for c, b in zip(core, box, strict=True))
            for k, v in tile(before[box], after[box], valid[box], displacement, s).items():
                out[k][core] = v[inner]
    return out


# Radiometry


def clipped(values: np.ndarray, s: Settings = Settings()) -> tuple[float, float]:
    """Median and MAD (scaled to a deviation, 1 at least) without the tails."""
    if not len(values):
        return 0.0, 1.0
    v = np.sort(values)
    start = int(np.floor(len(v) * s.clip))
    v = v[start : max(start + 1, int(np.ceil(len(v) * (1 - s.clip))))]
    middle = float(np.median(v))
    return middle, max(1.0, float(np.median(np.abs(v - middle))) * 1.4826)


def transform(reference: np.ndarray, current: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Gain and offset of each channel (columns of samples) that bring current to reference."""
    a, b = [clipped(x, s) for x in reference.T], [clipped(x, s) for x in current.T]
    gain = np.array([min(s.max_gain, max(s.min_gain, x[1] / max(1.0, y[1]))) for x, y in zip(a, b, strict=True)])
    return gain, np.array([x[0] for x in a]) - np.array([y[0] for y in b]) * gain


def residual(reference: np.ndarray, current: np.ndarray, gain: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Mean over channels of what the transform leaves."""
    return np.abs(reference - np.clip(current * gain + offset, 0, 255)).mean(axis=1)


def rank(values: np.ndarray, p: float) -> float:
    """Nearest-rank percentile; 0 of nothing."""
    return float(np.sort(values)[int(np.floor((len(values) - 1) * p + 0.5))]) if len(values) else 0.0


def normalized(before: np.ndarray, after: np.ndarray, valid: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """after with before's radiometry where valid, and the median difference before that. Two passes: the second without likely changes."""
    quiet = valid & (gradient(gray(before)) <= s.radiometric_gradient) & (gradient(gray(after)) <= s.radiometric_gradient)
    stride = max(1, int(valid.sum()) // s.samples)
    at = np.flatnonzero(quiet.ravel())[::stride]
    if len(at) < 100:
        some = np.arange(0, valid.size, stride)
        at = np.concatenate([at, some[valid.ravel()[some]]])
    a, b = before.reshape(-1, 3)[at].astype(np.float64), after.reshape(-1, 3)[at].astype(np.float64)
    left = residual(a, b, *transform(a, b, s))
    stable = left <= rank(left, s.provisional)
    gain, offset = transform(a[stable], b[stable], s) if stable.sum() >= 100 else transform(a, b, s)
    out = np.where(valid[..., None], near(np.clip(after * gain + offset, 0, 255)), after)
    raw = np.abs(a - b).mean(axis=1)
    return out.astype(np.uint8), float(np.median(raw)) if len(raw) else 0.0


# Masks


def disk(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r + 1]


def _by_disk(mask: np.ndarray, r: int, join) -> np.ndarray:
    p = np.pad(mask, r)
    h, w = mask.shape
    return join.reduce([p[r + y : r + y + h, r + x : r + x + w] for y, x in disk(r)])


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return _by_disk(mask, r, np.logical_or)


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    """What lies outside the image is unset."""
    return _by_disk(mask, r, np.logical_and)


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components numbered from 1 by their first pixel in raster order, by runs of set pixels."""
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int32)
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n = len(row)
    if not n:
        return out, 0
    wide = w + 2
    first, last = row * wide + start, row * wide + end
    lo, hi = np.searchsorted(last, first + wide, "left"), np.searchsorted(first, last + wide, "right")  # runs of the next row that touch
    k = np.maximum(hi - lo, 0)
    a, b = np.repeat(np.arange(n), k), np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    number = np.unique(root, return_inverse=True)[1] + 1
    size = end - start
    out[np.repeat(row, size), np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(number, size)
    return out, int(number.max())


def boxes(labels: np.ndarray, n: int) -> np.ndarray:
    """left, top, width, height and area by component, in the order of labels."""
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    low, high = np.full((n, 2), np.iinfo(np.int64).max), np.full((n, 2), -1)
    for j, v in enumerate((x, y)):
        np.minimum.at(low[:, j], k, v)
        np.maximum.at(high[:, j], k, v)
    return np.column_stack([low, high - low + 1, np.bincount(k, minlength=n)])


def without_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Unset pieces of at most so many pixels that don't touch the edge are set."""
    labels, n = label(~mask)
    if not n:
        return mask
    b, (h, w) = boxes(labels, n), mask.shape
    small = (b[:, 0] > 0) & (b[:, 1] > 0) & (b[:, 0] + b[:, 2] < w) & (b[:, 1] + b[:, 3] < h) & (b[:, 4] <= most)
    return mask | np.concatenate([[False], small])[labels]


def bands(diff: np.ndarray, grad: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Flat changed bands along the border: runs of rows or columns that reach it."""
    h, w = diff.shape
    some = (diff >= s.band_residual) & (grad <= s.band_gradient)
    out = np.zeros((h, w), dtype=bool)
    for axis, size in ((0, w), (1, h)):
        full = some.mean(axis=axis) >= s.band_coverage
        edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if (a == 0 or b == size) and 2 <= b - a <= max(2, int(size * s.band_thickness)):
                out[(slice(None), slice(a, b)) if axis == 0 else (slice(a, b), slice(None))] = True
    return out


def provisional(score: np.ndarray, c: np.ndarray, st: np.ndarray, valid: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Pixels of likely change: strong ones with four low ones (themselves included) around, widened by 2."""
    low = valid & (score >= s.low_floor)
    strong = valid & ((score >= s.high_floor) | ((score >= s.low_floor) & (st >= 92) & (c >= 14)))
    inner = np.zeros(valid.shape, dtype=bool)
    inner[1:-1, 1:-1] = True
    return dilate(strong & inner & (_sums(low, 1) >= 4), 2)


def cell_of(shape: tuple[int, int], n: int) -> np.ndarray:
    """Grid cell (row * n + column) of each pixel by its share of the image."""
    h, w = shape
    return np.minimum(n - 1, np.arange(h) * n // h)[:, None] * n + np.minimum(n - 1, np.arange(w) * n // w)


def unreliable(edge_residual: np.ndarray, registration: np.ndarray, ga: np.ndarray, gb: np.ndarray, likely: np.ndarray, valid: np.ndarray, raw: np.ndarray, s: Settings = Settings()) -> tuple[list[tuple], np.ndarray]:
    """Cells whose stable edges, or whose raw residuals together with a neighbour's, don't match, and their pixels.

    raw: the grid's residuals by cell. Cells: row, column, raw, stable residual (None with too few edges), reason.
    """
    n = s.grid
    cell = cell_of(valid.shape, n)
    edge = valid & ~likely & ((ga >= s.edge_gradient) | (gb >= s.edge_gradient))
    edges, unmatched = np.bincount(cell[edge], minlength=n * n), np.bincount(cell[edge & (edge_residual > 0)], minlength=n * n)
    severe = np.pad((raw > s.max_edge_residual).reshape(n, n), 1)
    near_severe = severe[1:-1, 1:-1] & (severe[:-2, 1:-1] | severe[2:, 1:-1] | severe[1:-1, :-2] | severe[1:-1, 2:])
    out = []
    for k in range(n * n):
        stable = unmatched[k] / edges[k] if edges[k] >= s.edges_per_cell else None
        if stable is not None and stable > s.max_edge_residual:
            out.append((k // n, k % n, float(raw[k]), float(stable), "STABLE_EDGE_RESIDUAL_HIGH"))
        elif near_severe.ravel()[k]:
            out.append((k // n, k % n, float(raw[k]), None if stable is None else float(stable), "ADJACENT_SEVERE_RAW_RESIDUAL"))
    bad = np.zeros(n * n, dtype=bool)
    bad[[r * n + c for r, c, *_ in out]] = True
    return out, bad[cell] & ~likely & (registration > s.max_registration)


#: Why pixels don't count as background, in their order.
EXCLUSIONS = ("ui_or_viewport", "invalid_overlap", "strong_gradient", "registration_residual", "provisional_change", "structural_change", "color_change")


def excluded(p: dict[str, np.ndarray], s: Settings = Settings()) -> np.ndarray:
    """Index of the first of EXCLUSIONS that holds for a pixel; their number for stable ones."""
    why = [
        ~p["in_view"], ~p["valid"], (p["before_gradient"] > s.max_gradient) | (p["after_gradient"] > s.max_gradient), p["registration"] > s.max_registration, p["likely"],
        p["structure"] > s.max_structure, p["color"] > s.max_color,
    ]
    return np.select(why, list(range(len(why))), default=len(why))


def _limits(values: np.ndarray, everything: np.ndarray, s: Settings) -> tuple[float, float, float, float]:
    """Median, MAD, the high threshold they ask for, and the guard by the share of seeds."""
    middle = float(np.median(values)) if len(values) else 0.0
    mad = float(np.median(np.abs(values - middle))) if len(values) else 0.0
    return middle, mad, middle + s.high_mads * max(2.0, mad), rank(everything, 1 - s.seed_share)


def _without_tail(values: np.ndarray, s: Settings) -> np.ndarray:
    middle = np.median(values) if len(values) else 0.0
    mad = np.median(np.abs(values - middle)) if len(values) else 0.0
    return values[values <= middle + s.tail_mads * max(2.0, mad)]


def thresholds(p: dict[str, np.ndarray], s: Settings = Settings()) -> dict:
    """Global low and high threshold, and how they came about."""
    score, why = p["score"], excluded(p, s)
    seen = why >= 2
    valid, candidates = score[seen], score[why == len(EXCLUSIONS)]
    stable = _without_tail(candidates, s)
    values = stable if len(stable) else candidates if len(candidates) else valid
    middle, mad, raw_high, guard = _limits(values, valid, s)
    high = min(s.high_ceiling, max(s.high_floor, raw_high, guard))
    raw_low = max(high * s.low_share, middle + s.low_mads * max(2.0, mad))
    low = min(max(s.low_floor, high - 1), max(s.low_floor, raw_low))
    counts = dict(zip(EXCLUSIONS, np.bincount(why.ravel(), minlength=len(EXCLUSIONS) + 1).tolist(), strict=False))
    enough = len(stable) >= max(s.stable_pixels, int(near(len(valid) * s.stable_share)))
    return {"low": float(low), "high": float(high), "raw_high": raw_high, "raw_low": float(raw_low), "median": middle, "mad": mad, "guard": guard, "valid": len(valid), "stable": len(stable), "enough": enough, **counts, "extreme_score_tail": len(candidates) - len(stable)}


def local_thresholds(p: dict[str, np.ndarray], glob: dict, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Rounded low and high thresholds by pixel, from the cells of a grid; high at least and at most so far from the global one."""
    score, why = p["score"], excluded(p, s)
    h, w = score.shape
    low_map, high_map = np.zeros((h, w)), np.zeros((h, w))
    for r in range(s.cells):
        for c in range(s.cells):
            box = slice(r * h // s.cells, (r + 1) * h // s.cells), slice(c * w // s.cells, (c + 1) * w // s.cells)
            valid, stable = score[box][why[box] >= 2], _without_tail(score[box][why[box] == len(EXCLUSIONS)], s)
            middle, mad, raw, guard = _limits(stable if len(stable) else valid, valid, s)
            least_high = max(s.high_floor, glob["high"])
            most_high = max(least_high, min(s.high_ceiling, glob["high"] * s.local_high))
            high = min(most_high, max(least_high, raw, guard, s.high_floor))
            least_low = max(s.low_floor, glob["low"] * s.local_low)
            low = min(max(least_low, high - 1), max(least_low, high * s.low_share, middle + s.low_mads * max(2.0, mad)))
            low_map[box], high_map[box] = near(np.float64(low)), near(np.float64(high))
    return low_map, high_map
