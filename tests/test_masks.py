"""Runs, components and holes against pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.operators import runs as R
from parcelflow.operators import trees
from parcelflow.operators.detector import state_mask
from parcelflow.plans import masks
from parcelflow.sources.scratch import Scratch

KEYS = ["f"]


def planes(seed, sizes, share):
    rng = np.random.default_rng(seed)
    return {k: rng.random((h, w)) < share for k, (h, w) in enumerate(sizes)}


def rows_of(spark, frames):
    rows = [(k, y, [int(v) for v in line]) for k, m in frames.items() for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "f long, y long, v array<long>")


def mask_of(spark, frames):
    runs = R.of_rows(rows_of(spark, frames), KEYS, "v", lambda v: v > 0)
    return runs.select("f", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), "x0", "x1")


def drawn(runs, frames):
    out = {k: np.zeros(m.shape, int) for k, m in frames.items()}
    for r in runs.collect():
        out[r.f][r.y0 : r.y1, r.x0 : r.x1] += 1
    return out


def same(got, want):
    assert all((got[k] == want[k].astype(int)).all() for k in want)


SIZES = [(7, 13), (30, 5), (1, 40), (12, 12)]


def test_sets_of_masks_are_those_of_their_pixels(spark):
    a, b = planes(1, SIZES, 0.4), planes(2, SIZES, 0.6)
    a[3][:], b[2][:] = False, True
    x, y = mask_of(spark, a), mask_of(spark, b)
    frames = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in a.items()], "f long, width long, height long")
    same(drawn(R.union(KEYS, x, y), a), {k: a[k] | b[k] for k in a})
    same(drawn(R.intersection(KEYS, x, y), a), {k: a[k] & b[k] for k in a})
    same(drawn(R.difference(KEYS, x, y), a), {k: a[k] & ~b[k] for k in a})
    same(drawn(R.complement(KEYS, x, frames), a), {k: ~a[k] for k in a})
    got = {r.f: (r.both, r.a) for r in R.tally(R.sweep(R.named(a=x, b=y), KEYS, ["a", "b"]), KEYS, both=(F.col("a") > 0) & (F.col("b") > 0), a=F.col("a") > 0).collect()}
    assert got == {k: ((a[k] & b[k]).sum(), a[k].sum()) for k in a}


def test_boxes_that_overlap_and_reach_out_of_the_frame(spark):
    rng = random.Random(3)
    boxes = [(k % 2, rng.randrange(-5, 25), rng.randrange(-5, 25), rng.randrange(0, 12), rng.randrange(0, 12)) for k in range(30)]
    want = {k: np.zeros((20, 30), bool) for k in (0, 1)}
    for f, x, y, w, h in boxes:
        want[f][max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = True
    runs = R.of_boxes(spark.createDataFrame(boxes, "f long, left long, top long, width long, height long"), "f")
    frames = spark.createDataFrame([(0, 30, 20), (1, 30, 20)], "f long, width long, height long")
    same(drawn(R.intersection(KEYS, runs, R.frame(frames, KEYS)), want), want)
    assert R.union(KEYS, runs.where("false")).collect() == []


def brute_parts(mask, four):
    """Components numbered in raster order."""
    out, n = np.zeros(mask.shape, int), 0
    for y0, x0 in zip(*np.nonzero(mask), strict=True):
        if not out[y0, x0]:
            n += 1
            out[y0, x0], todo = n, [(y0, x0)]
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        v, u = y + dy, x + dx
                        if (not four or dy * dx == 0) and 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                            out[v, u] = n
                            todo.append((v, u))
    return out


@pytest.mark.parametrize("four", [False, True])
def test_components_of_frames_of_unequal_sizes(spark, monkeypatch, four):
    monkeypatch.setattr(R, "STRIP", 4)
    frames = planes(5, [*SIZES, (25, 33)], 0.5)
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    frames[9] = spiral
    parts = R.labelled(Scratch(spark, "t"), R.of_rows(rows_of(spark, frames), KEYS, "v", lambda v: v > 0), KEYS, four)
    got = {k: np.zeros(m.shape, int) for k, m in frames.items()}
    for r in parts.collect():
        got[r.f][r.y, r.x0 : r.x1] = r.component
        assert r.v == [1] * (r.x1 - r.x0)
    assert all((got[k] == brute_parts(m, four)).all() for k, m in frames.items())


def test_holes_and_seeds(spark):
    frames = planes(8, [(20, 31), (9, 9), (3, 3)], 0.62)
    frames[2] = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)
    size = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in frames.items()], "f long, width long, height long")
    mask = R.of_rows(rows_of(spark, frames), KEYS, "v", lambda v: v > 0).drop("v")
    got = {k: np.zeros(m.shape, bool) for k, m in frames.items()}
    for r in R.holes(Scratch(spark, "t"), mask, size, KEYS).collect():
        got[r.f][r.y, r.x0 : r.x1] = True
    for k, m in frames.items():
        parts = brute_parts(~m, True)
        edge = set(parts[0]) | set(parts[-1]) | set(parts[:, 0]) | set(parts[:, -1])
        assert (got[k] == ((parts > 0) & ~np.isin(parts, list(edge)))).all()
    seeds = planes(9, [(20, 31), (9, 9), (3, 3)], 0.05)
    labelled = R.labelled(Scratch(spark, "t"), mask, KEYS)
    kept = {(r.f, r.component) for r in R.seeded(labelled, R.of_rows(rows_of(spark, seeds), KEYS, "v", lambda v: v > 0).drop("v"), KEYS).collect()}
    assert kept == {(k, int(c)) for k, m in frames.items() for c in np.unique(brute_parts(m, False)[seeds[k] & m])}


def test_the_state_mask_of_regions(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {1: np.zeros((300, 300), bool), 2: np.zeros((300, 300), bool)}
    for k in range(12):
        h, w, top, left, state = *rng.integers(1, 90, 2), *rng.integers(0, 200, 2), ("accepted", "needs_review", "rejected")[k % 3]
        s = (rng.random((h, w)) < 0.5).astype(np.uint8)
        rows.append((1 + k % 2, state, int(left), int(top), int(w), int(h), bytearray(s.tobytes())))
        if state != "rejected":
            want[1 + k % 2][top : top + h, left : left + w] |= s.astype(bool)
    rows.append((1, "accepted", 1, 1, 5, 5, None))
    df = spark.createDataFrame(rows, "pair_id long, state string, left int, top int, width int, height int, support binary")
    got = {k: np.zeros((300, 300), int) for k in want}
    for r in state_mask(df, ("accepted", "needs_review")).collect():
        got[r.pair_id][r.y0 : r.y1, r.x0 : r.x1] += 1
    same(got, want)


def test_box_masks_by_pixels(spark):
    """mask_algebra's counts against masks of 1,000 x 1,000 pixels, for every pair of the smallest tables."""
    d = "/root/testdata/sf0.001"
    boxes = {}
    for r in masks.T.proposals(spark, d).select("pair_id", "flag", "left", "top", "width", "height").collect():
        m = boxes.setdefault(r.pair_id, np.zeros((2, 1000, 1000), bool) if len(boxes) < 150 else None)
        if m is not None:
            m[0 if r.flag == "R" else 1, r.top : r.top + r.height, r.left : r.left + r.width] = True
    got = {r.pair_id: r for r in masks.mask_algebra(spark, d).collect()}
    assert set(got) == set(boxes)
    for k, m in boxes.items():
        if m is not None:
            t, f = m
            starts = f & ~np.pad(f, ((0, 0), (1, 0)))[:, :-1]
            r = got[k]
            assert (r.either, r.both, r.only_truth, r.only_found, r.neither, r.found_runs) == ((t | f).sum(), (t & f).sum(), (t & ~f).sum(), (f & ~t).sum(), (~t & ~f).sum(), starts.sum())


def test_no_python_and_no_pixel_rows(spark):
    for q in (masks.mask_algebra, masks.mask_confusion, masks.scene_components):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_a_component_tree_holds_the_components_of_every_threshold(spark):
    """Two blocks joined by a weak line: one component that splits, as are the frame's others at every level."""
    rng = np.random.default_rng(6)
    a = np.zeros((24, 60), int)
    a[4:20, 4:20] = a[4:20, 40:56] = 230
    a[12, 20:40] = 90
    frames = {0: a, 1: rng.integers(0, 256, (15, 300)), 2: rng.integers(0, 256, (40, 9))}
    rows = spark.createDataFrame([(k, y, [int(v) for v in line]) for k, m in frames.items() for y, line in enumerate(m)], "f long, y long, v array<long>")
    levels = [80, 120, 200]
    nodes, _ = trees.component_tree(Scratch(spark, "t"), rows, KEYS, "v", levels)
    got = {(r.f, r.level, r.component): r for r in nodes.collect()}
    parts = {(k, t): brute_parts(m >= t, False) for k, m in frames.items() for t in levels}
    assert set(got) == {(k, t, c) for (k, t), p in parts.items() for c in range(1, p.max() + 1)}
    for (k, t, c), r in got.items():
        inside = parts[k, t] == c
        assert r.area == inside.sum() and r.peak == frames[k][inside].max()
        assert r.base == parts[k, 80][inside].min() == parts[k, 80][inside].max()
        assert r.parent == (None if t == 80 else parts[k, levels[levels.index(t) - 1]][r.y, r.x])
    split = {(r.f, r.component): (r.level, r.cores, r.core_area) for r in trees.splits(nodes, KEYS, 100).collect()}
    assert split[0, 1] == (120, 2, 512)


def test_coverage_is_that_of_pixels_for_small_and_large_frames(spark, monkeypatch):
    rng = random.Random(12)
    rows, want = [], {}
    for k, n in enumerate([1, 2, 3, 5, 9, 30]):
        grid = [[0] * 40 for _ in range(40)]
        for _ in range(n):
            y, x, h, w, m = rng.randrange(30), rng.randrange(30), rng.randrange(0, 10), rng.randrange(1, 10), rng.randrange(2)
            rows.append((k, y, y + h, x, x + w, "ab"[m]))
            for i in range(y, y + h):
                for j in range(x, x + w):
                    grid[i][j] |= 1 << m
        flat = [(v, line[j - 1] if j else 0) for line in grid for j, v in enumerate(line)]
        want[k] = (sum(v == 1 for v, _ in flat), sum(v == 2 for v, _ in flat), sum(v == 3 for v, _ in flat), sum(v > 0 and p == 0 for v, p in flat))
    df = spark.createDataFrame(rows, "k long, y0 long, y1 long, x0 long, x1 long, mask string")

    def told():
        got = R.coverage(Scratch(spark, "t"), df, ["k"], ["a", "b"]).collect()
        by = lambda k, f: sum(f(r) for r in got if r.k == k)
        return {k: (*(by(k, lambda r, v=v: r.pixels * (r.bits == v)) for v in (1, 2, 3)), by(k, lambda r: r.rows * (r.before == 0))) for k in want}

    assert told() == want
    plan = R.coverage(Scratch(spark, "t"), df, ["k"], ["a", "b"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate" not in plan
    monkeypatch.setattr(R, "CHUNK", 4)
    assert told() == want


def test_components_and_holes_broadcast_nothing(spark, monkeypatch):
    from parcelflow.plans import catalog
    from parcelflow.sources.scratch import Scratch

    plans, put = {}, Scratch.put

    def told(self, df, name="table"):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, name)

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    monkeypatch.setattr(Scratch, "put", told)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        last = catalog.QUERIES["scene_holes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    rounds = [*plans["edges"], last]
    assert len(rounds) > 2 and not any("Broadcast" in p for p in rounds)
