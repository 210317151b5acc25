"""The detector: aligned pairs of images to candidates, regions and a state for each pair.

Tiles of a pair spread over tasks for the evidence (the costly part); planes, stitched again, give
masks and components of one pair, which the guard of the image source bounds. A pair is then one
row with an array of its components' features; scores, gates, states, ranks and regions are column
expressions over the exploded array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators import evidence as E
from parcelflow.operators import runs, shapes
from parcelflow.operators.registration import UI_BOXES, gradient, gray, viewport
from parcelflow.operators.settings import Settings, minimum_area, scale_parameters
from parcelflow.plans import decisions
from parcelflow.sources.shipping import ship

_FEATURES = (
    "component int, parent int, split boolean, left int, top int, width int, height int, area int, min_area int, cx double, cy double, inside_mean double, median double, annulus_mean double, annulus_median double, "
    "contrast double, z double, structural double, color_support double, removal double, edge_support double, stability double, residual double, edge_only double, compactness double, "
    "density double, border double, coverage double, high_seeds int, in_view boolean, label_like boolean, polygon array<struct<x:double,y:double>>, perimeter double, support binary"
)
_NAMES = [c.split()[0] for c in _FEATURES.split(", ")]
_STATS = (
    "low double, high double, noise_median double, noise_mad double, enough_background boolean, stable_pixels long, valid_pixels long, low_pixels long, mask_pixels long, high_pixels long, "
    "band_pixels long, edge_only_share double, raw_residual double, ui_share double, known_scale boolean, cells array<struct<row:int,column:int,raw:double,stable:double,reason:string>>, exclusions map<string,long>"
)
_OUT = f"pair_id long, frame_width int, frame_height int, mpp double, {_STATS}, components array<struct<{_FEATURES.replace(' ', ':', 0)}>>"
_OUT = _OUT.replace(_FEATURES, ", ".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in _FEATURES.split(", ")))
_TILE = "pair_id long, top int, left int, bottom int, right int, pad_top int, pad_left int, rows int, cols int, radius int, before binary, after binary, valid binary"
_CORE = "pair_id long, top int, left int, rows int, cols int, planes binary"


def shape_of(r) -> tuple[int, int]:
    return int(r.height), int(r.width)


def rgb_of(raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(*shape, 3)


def plane_of(raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(shape)


def ui(shape: tuple[int, int]) -> np.ndarray:
    """Pixels under the map's interface; far edges of its boxes are outside."""
    h, w = shape
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    return np.logical_or.reduce([(x >= a * w) & (x < (a + c) * w) & (y >= b * h) & (y < (b + d) * h) for a, b, c, d in UI_BOXES])


def _mpp(r) -> float | None:
    return None if r.mpp is None or math.isnan(r.mpp) else float(r.mpp)


def _tiles(s: Settings):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                h, w = shape = shape_of(r)
                before, valid = rgb_of(r.before, shape), plane_of(r.valid, shape) > 0
                after, _ = E.normalized(before, rgb_of(r.after, shape), valid, s)
                radius = scale_parameters(_mpp(r), s)["displacement"]
                m = E.halo(radius, s)
                for top in range(0, h, s.tile_size):
                    for left in range(0, w, s.tile_size):
                        bottom, right = min(h, top + s.tile_size), min(w, left + s.tile_size)
                        box = slice(max(0, top - m), min(h, bottom + m)), slice(max(0, left - m), min(w, right + m))
                        rows, cols = box[0].stop - box[0].start, box[1].stop - box[1].start
                        yield pd.DataFrame([(
                            r.pair_id, top, left, bottom, right, top - box[0].start, left - box[1].start, rows, cols, radius,
                            before[box].tobytes(), after[box].tobytes(), valid[box].astype(np.uint8).tobytes(),
                        )], columns=[c.split()[0] for c in _TILE.split(", ")])

    return run


def _cores(s: Settings):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                shape = int(r.rows), int(r.cols)
                got = E.tile(rgb_of(r.before, shape), rgb_of(r.after, shape), plane_of(r.valid, shape) > 0, int(r.radius), s)
                rows, cols = r.bottom - r.top, r.right - r.left
                core = slice(r.pad_top, r.pad_top + rows), slice(r.pad_left, r.pad_left + cols)
                raw = np.stack([got[k][core] for k in E.PLANES]).astype(np.uint8).tobytes()
                yield pd.DataFrame([(r.pair_id, r.top, r.left, rows, cols, raw)], columns=[c.split()[0] for c in _CORE.split(", ")])

    return run


def hysteresis(p: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, glob_low: float, scale: dict, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High, low and final mask: the low one closed, opened, filled; components with a seed, or coherent without one."""
    score, valid = p["score"], p["valid"]
    over_high, over_low = valid & (score >= high), valid & (score >= low)
    mask = over_low
    if scale["closing"]:
        mask = E.erode(E.dilate(mask, scale["closing"]), scale["closing"])
    if scale["opening"]:
        mask = E.dilate(E.erode(mask, scale["opening"]), scale["opening"])
    mask = E.without_holes(mask, scale["hole"])
    labels, n = E.label(mask)
    keep = np.zeros(n + 1, dtype=bool)
    keep[np.unique(labels[over_high])] = True
    keep[0] = False
    for k, at, box in _each(labels, n):
        if not keep[k]:
            keep[k] = coherent(p, at, box, mask, glob_low, s)
    return over_high, over_low, keep[labels]


def _each(labels: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, tuple[int, ...]]]:
    """Number, flat pixels and box of each component."""
    at = np.flatnonzero(labels)
    at = at[np.argsort(labels.ravel()[at], kind="stable")]
    ends = np.cumsum(np.bincount(labels.ravel(), minlength=n + 1)[1:]) if n else []
    box = E.boxes(labels, n) if n else []
    for k in range(n):
        yield k + 1, at[(ends[k - 1] if k else 0) : ends[k]], tuple(int(v) for v in box[k][:4])


def _ring(plane: np.ndarray, box: tuple[int, ...], outside: np.ndarray, r: int) -> np.ndarray:
    """Values around and in a box where outside holds."""
    left, top, w, h = box
    s = slice(max(0, top - r), top + h + r), slice(max(0, left - r), left + w + r)
    return plane[s][outside[s]]


def _median(v: np.ndarray) -> float:
    return float(np.median(v)) if len(v) else 0.0


def _mean(v: np.ndarray) -> float:
    return float(v.mean()) if len(v) else 0.0


def coherent(p: dict[str, np.ndarray], at: np.ndarray, box: tuple[int, ...], mask: np.ndarray, low: float, s: Settings) -> bool:
    """Whether a component without a seed has enough evidence of other kinds."""
    if len(at) < s.low_only_pixels:
        return False
    score = p["score"].ravel()[at]
    contrast = (_median(score) - _median(_ring(p["score"], box, p["valid"] & ~mask, s.annulus))) / 255
    w, h = box[2:]
    checks = (
        _median(score) >= low * 1.08, _mean(p["structure"].ravel()[at] / 255) >= 0.2 * 0.7, _mean(np.minimum(1, p["color"].ravel()[at] / 64)) >= 0.28,
        _mean(p["removal"].ravel()[at] / 255) >= 0.34, contrast >= 0.12 * 0.55, w >= 4 and h >= 4 and len(at) / (w * h) >= 0.12,
    )
    return sum(map(bool, checks)) >= s.low_only_checks


def borders(member: np.ndarray, valid: np.ndarray) -> tuple[int, float, float]:
    """Of a component (in a frame padded by one): outer sides, share of border pixels, share of those that touch what isn't valid."""
    inner = member[1:-1, 1:-1]
    around = [(slice(0, -2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(0, -2)), (slice(1, -1), slice(2, None))]
    open_sides = np.sum([inner & ~member[a] for a in around], axis=0)
    edge = open_sides > 0
    invalid = edge & np.logical_or.reduce([~valid[a] for a in around])
    return int(open_sides.sum()), edge.sum() / max(1, inner.sum()), invalid.sum() / max(1, edge.sum())


def stability(score: np.ndarray, low: float, high: float) -> float:
    """How much of a component stays at a higher low threshold, and how much reaches the high one."""
    core, seeds = (score >= low * 1.12).mean(), (score >= high).mean()
    margin = min(1.0, max(0.0, (_median(score) - low) / max(1.0, high - low)))
    return float(min(1.0, max(0.0, min(1, core / 0.55) * 0.42 + min(1, seeds / 0.12) * 0.34 + margin * 0.24)))


def _parts(labels: np.ndarray, n: int, score: np.ndarray, high: float) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Parent, whether split, and flat pixels of each component after weak ones are split."""
    width = labels.shape[1]
    for k, at, (_, _, w, h) in _each(labels, n):
        if len(at) >= shapes.SPLIT_AREA and min(w, h) >= shapes.SPLIT_SIDE and len(at) / (w * h) <= shapes.SPLIT_DENSITY:
            rows = pd.DataFrame({"pair_id": 0, "component": k, "y": at // width, "x": at % width, "score": score.ravel()[at]})
            got = shapes.split(rows, high)
            parts = [(g["y"] * width + g["x"]).to_numpy() for _, g in got.groupby("part")]
            for part in parts:
                yield k, len(parts) > 1, part
        else:
            yield k, False, at


def features(p: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, seeds: np.ndarray, low: float, high: float, view: tuple[int, int], s: Settings) -> dict:
    """What the gates and the score of one component need; at: its pixels, mask: all components' pixels."""
    h, w = mask.shape
    y, x = np.divmod(at, w)
    left, top, width, height = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
    box, outside, area = (left, top, width, height), p["valid"] & ~mask, len(at)
    score = p["score"].ravel()[at]
    ring = _ring(p["score"], box, outside, s.annulus) / 255
    inside, around = _median(score / 255), _median(ring)
    member, valid = np.zeros((height + 2, width + 2), bool), np.zeros((height + 2, width + 2), bool)
    member[y - top + 1, x - left + 1] = True
    y0, x0 = max(0, top - 1), max(0, left - 1)
    part = p["valid"][y0 : top + height + 1, x0 : left + width + 1]
    valid[y0 - top + 1 : y0 - top + 1 + part.shape[0], x0 - left + 1 : x0 - left + 1 + part.shape[1]] = part
    perimeter, boundary, border = borders(member, valid)
    edge_residual = p["edge_residual"].ravel()[at]
    density, thickness = area / (width * height), area / max(width, height)
    edge_only = min(1.0, max((edge_residual > 0).mean(), boundary * (1 if thickness < 5 else 0.35)))
    of = lambda k: p[k].ravel()[at] / 255
    around_edges = _ring(p["edge_residual"], box, outside, 2 * s.annulus)
    outline = shapes.outline(member[1:-1, 1:-1])
    line = shapes.simplified(outline, max(1.0, shapes.TOLERANCE * _length(outline)))
    line = line if len(line) >= 3 else outline
    cx, cy = float(x.mean()), float(y.mean())
    return {
        "left": left, "top": top, "width": width, "height": height, "area": area, "cx": cx, "cy": cy, "inside_mean": _mean(score / 255), "median": inside, "annulus_mean": _mean(ring), "annulus_median": around,
        "contrast": inside - around, "z": (inside - around) / max(0.025, _median(np.abs(ring - around)) * 1.4826), "structural": _mean(of("structure")), "color_support": _mean(np.minimum(1, p["color"].ravel()[at] / 64)),
        "removal": _mean(of("removal")), "edge_support": _mean(edge_residual / 255), "stability": stability(score, low, high), "residual": min(1.0, _mean(around_edges / 255) * 2), "edge_only": float(edge_only),
        "compactness": min(1.0, 4 * math.pi * area / max(1, perimeter**2)), "density": density, "border": float(border), "coverage": float(p["valid"][top : top + height, left : left + width].mean()),
        "high_seeds": int(seeds.ravel()[at].sum()), "in_view": bool(0 <= cx < view[0] and 0 <= cy < view[1]),
        "label_like": bool(height <= 0.06 * h and width / height >= 2 and density >= 0.55 and edge_only >= 0.35),
        "polygon": [{"x": (px + left) * 100 / w, "y": (py + top) * 100 / h} for px, py in line], "perimeter": _length(line), "support": member[1:-1, 1:-1].astype(np.uint8).tobytes(),
    }


def _length(points: list[tuple[int, int]]) -> float:
    return float(sum(math.dist(a, b) for a, b in zip(points, [*points[1:], points[0]], strict=True)))


def workspace(before: np.ndarray, after: np.ndarray, p: dict[str, np.ndarray], grid: list[float], mpp: float | None, s: Settings = Settings()) -> dict:
    """From a pair's planes (evidence.PLANES, valid, edge_residual, registration) its thresholds, masks and components."""
    shape = h, w = p["valid"].shape
    scale, valid = scale_parameters(mpp, s), p["valid"]
    views = [viewport(before), viewport(after)]
    right, bottom = min(v[0] for v in views), min(v[1] for v in views)
    band = E.bands(E.direct(before, after), gradient(gray(after)), s)
    p = p | {k: np.where(band, 0, p[k]) for k in ("color", "structure", "edge", "removal")}
    score = E.combined(p["color"], p["structure"], p["edge"], p["removal"], valid, s)
    likely = E.provisional(score, p["color"], p["structure"], valid, s)
    cells, shaky = E.unreliable(p["edge_residual"], p["registration"], p["before_gradient"], p["after_gradient"], likely, valid, np.asarray(grid), s)
    score = np.where(shaky, E.near(score * 0.35), score)
    in_view = ~ui(shape) & (np.arange(w) < right) & (np.arange(h) < bottom)[:, None]
    p = p | {"score": score, "likely": likely, "in_view": in_view}
    t = E.thresholds(p, s)
    low_map, high_map = E.local_thresholds(p, t, s)
    seeds, low, mask = hysteresis(p, low_map, high_map, t["low"], scale, s)
    labels, n = E.label(mask)
    rows = []
    for k, (parent, split, at) in enumerate(_parts(labels, n, score, t["high"])):
        got = features(p, at, mask, seeds, t["low"], t["high"], views[0], s)
        rows.append({"component": k + 1, "parent": parent, "split": split, "min_area": minimum_area(mpp, 1.0, s)} | got)
    n_valid = max(1, int(valid.sum()))
    thin = valid & (p["edge_residual"] > 0) & (p["color"] < 44) & (p["structure"] < 64)
    return {
        "low": t["low"], "high": t["high"], "noise_median": t["median"], "noise_mad": t["mad"], "enough_background": t["enough"], "stable_pixels": t["stable"], "valid_pixels": int(valid.sum()),
        "low_pixels": int(low.sum()), "mask_pixels": int(mask.sum()), "high_pixels": int(seeds.sum()), "band_pixels": int(band.sum()), "edge_only_share": float(thin.sum() / n_valid),
        "raw_residual": E.normalized(before, after, valid, s)[1], "ui_share": max(1 - a * b / max(1, w * h) for a, b in views), "known_scale": bool(scale["known"]),
        "cells": [dict(zip(("row", "column", "raw", "stable", "reason"), c, strict=True)) for c in cells], "exclusions": {k: int(t[k]) for k in (*E.EXCLUSIONS, "extreme_score_tail")}, "components": rows, "mask": mask, "score": score,
    }


def _build(s: Settings):
    columns = [c.split()[0] for c in ("pair_id frame_width frame_height mpp " + " ".join(x.split()[0] for x in _STATS.split(", ") if ":" not in x.split()[0])).split()]

    def one(pairs: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pairs.itertuples():
            h, w = shape = shape_of(r)
            p = {k: np.zeros(shape, np.uint8) for k in E.PLANES}
            for c in cores.itertuples():
                got = np.frombuffer(c.planes, np.uint8).reshape(len(E.PLANES), c.rows, c.cols)
                for k, v in zip(E.PLANES, got, strict=True):
                    p[k][c.top : c.top + c.rows, c.left : c.left + c.cols] = v
            p |= {"valid": plane_of(r.valid, shape) > 0, "edge_residual": plane_of(r.edge_residual, shape), "registration": plane_of(r.registration, shape)}
            got = workspace(rgb_of(r.before, shape), rgb_of(r.after, shape), p, list(r.grid), _mpp(r), s)
            rows.append({"pair_id": r.pair_id, "frame_width": w, "frame_height": h, "mpp": _mpp(r)} | {k: v for k, v in got.items() if k not in ("mask", "score")})
        return pd.DataFrame(rows, columns=[*dict.fromkeys([*columns, "cells", "exclusions", "components"])])

    return one


PAIR = ("pair_id", "width", "height", "before", "after", "valid", "edge_residual", "registration", "grid", "mpp")


def workspaces(pairs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of PAIR columns (RGB and planes of bytes, the grid's raw edge residuals by cell, metres per pixel or null): a row for each pair.

    Columns: the pair's thresholds and counts, and components, an array of features. pair_id is
    the pairs' key. Pairs whose registration isn't reliable are left out before.
    """
    ship(pairs.sparkSession)
    rows = pairs.select(*PAIR)
    tiles = rows.select("pair_id", "width", "height", "before", "after", "valid", "mpp").mapInPandas(_tiles(s), _TILE)
    cores = tiles.repartition("pair_id", "top", "left").mapInPandas(_cores(s), _CORE)
    return rows.groupBy("pair_id").cogroup(cores.groupBy("pair_id")).applyInPandas(_build(s), _OUT)


def candidates(spaces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each component: its features, score, limiting factor, reasons and state."""
    pair = ["pair_id", "frame_width", "frame_height", "mpp", "known_scale", "edge_only_share"]
    rows = spaces.select(*pair, (F.col("low") / 255).alias("low"), F.inline("components"))
    rows = rows.withColumn("seeded", F.col("high_seeds") > 0).withColumn("candidate_id", F.col("component").cast("long"))
    return decisions.judge(rows, accept=s.accept, compatible=F.col("edge_only_share") <= s.max_edge_only)


def rank_value() -> Column:
    """Of two candidates of one score the larger and stronger comes first."""
    return F.sqrt(F.col("width") * F.col("height")) * (0.45 + F.col("density") + F.col("inside_mean"))


def regions(judged: DataFrame) -> DataFrame:
    """Accepted regions (R1, R2, ...), those to review (V1, ...) and rejected ones (X and the component's number), with percent boxes and areas."""
    at = F.row_number().over(Window.partitionBy("pair_id", "state").orderBy(F.desc("score"), rank_value().desc(), "component"))
    name = F.when(F.col("state") == "accepted", F.concat(F.lit("R"), at)).when(F.col("state") == "needs_review", F.concat(F.lit("V"), at)).otherwise(F.concat(F.lit("X"), F.col("component")))
    pct = lambda c, of: F.round(F.col(c) * 100.0 / F.col(of), 3)
    known = F.col("mpp") > 0
    return judged.select(
        "pair_id", name.alias("region_id"), "component", "state", "score", "reasons", pct("left", "frame_width").alias("x"), pct("top", "frame_height").alias("y"), pct("width", "frame_width").alias("w"),
        pct("height", "frame_height").alias("h"), F.col("area").alias("pixel_area"), F.when(known, F.round(F.col("area") * F.col("mpp") * F.col("mpp"), 3)).alias("area_m2"),
        F.when(known, F.struct(F.round(F.col("width") * F.col("mpp"), 3).alias("width_m"), F.round(F.col("height") * F.col("mpp"), 3).alias("height_m"))).alias("dimensions"),
        F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round("perimeter", 3).alias("perimeter"), "polygon", "support", "left", "top", "width", "height",
    )


def warnings(s: Settings = Settings()) -> Column:
    """Codes of what a reader of the result must know, in a fixed order."""
    c = F.col
    holds = {
        "BORDER_OVERLAY_ARTIFACT_EXCLUDED": c("band_pixels") > 0, "UI_ELEMENTS_DETECTED": c("ui_share") > s.max_ui, "LOCAL_ALIGNMENT_UNRELIABLE": F.size("cells") > 0,
        "THRESHOLD_ESTIMATOR_UNCERTAIN": ~c("enough_background"), "STRONG_RADIOMETRIC_SHIFT": c("raw_residual") > s.max_raw_residual,
        "WIDESPREAD_CHANGE_REVIEW": c("mask_pixels") / F.greatest(F.lit(1), c("valid_pixels")) > s.max_changed, "INCONSISTENT_RENDERING_OR_LABELS": c("edge_only_share") > s.max_edge_only,
        "CANDIDATE_SATURATION": F.coalesce(c("n_accepted") + c("n_review"), F.lit(0)) > s.regions,
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in holds.items())))


def detect(pairs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Regions, and one row for each pair: its state, warnings, counts and thresholds.

    pairs: PAIR columns and reliable (a null one counts as false). Pairs that aren't reliable have an empty workspace:
    no regions, no thresholds, the state REGISTRATION_UNRELIABLE. Workspaces are kept for both results by the
    caller (persist() or a written table) if both are used.
    """
    trusted = F.coalesce(F.col("reliable"), F.lit(False))
    spaces = workspaces(pairs.where(trusted), s)
    judged = candidates(spaces, s)
    n = lambda state: F.count_if(F.col("state") == state)
    counts = judged.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_candidates"), n("accepted").alias("n_accepted"), n("needs_review").alias("n_review"), n("rejected").alias("n_rejected"))
    rows = pairs.select("pair_id", trusted.alias("reliable")).join(spaces.drop("components"), "pair_id", "left").join(counts, "pair_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_candidates", "n_accepted", "n_review", "n_rejected")})
    rows = rows.withColumn("warnings", F.when(F.col("reliable"), warnings(s)).otherwise(F.array().cast("array<string>")))
    state = decisions.pair_state(
        F.col("reliable"), F.coalesce(F.col("edge_only_share") <= s.max_edge_only, F.lit(True)), F.array_contains("warnings", "WIDESPREAD_CHANGE_REVIEW"),
        F.col("n_accepted"), F.col("n_review"), F.col("n_candidates"), F.coalesce(F.col("low_pixels") + F.col("mask_pixels"), F.lit(0)),
    )
    return regions(judged), rows.withColumn("state", state)


def state_mask(regions: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """The mask of regions in one of these states as runs (pair_id, y0, y1, x0, x1), rebuilt from the supports whenever states have changed.

    A support is taken apart row by row, so the cost grows with its bytes.
    """
    rows = regions.where(F.col("state").isin(*states) & F.col("support").isNotNull()).select("pair_id", "left", "top", F.col("width").cast("int").alias("w"), "support", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("i"))
    row = F.hex(F.substring("support", F.col("i") * F.col("w") + 1, F.col("w")))
    rows = rows.select("pair_id", "left", (F.col("top") + F.col("i")).alias("y"), F.slice(F.split(F.regexp_replace(row, "(..)", "$1,"), ","), F.lit(1), F.col("w")).alias("bits"))
    lines = runs.of_rows(rows, ["pair_id", "left"], "bits", lambda b: b == "01")
    lines = lines.select("pair_id", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), (F.col("x0") + F.col("left")).alias("x0"), (F.col("x1") + F.col("left")).alias("x1"))
    return runs.union(["pair_id"], lines)
