"""Stencils by tiles against whole frames, for tiles that cut through everything."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parcelflow.operators import levels as L
from parcelflow.operators import stencils as S
from parcelflow.operators.settings import Settings
from parcelflow.plans import catalog
from parcelflow.sources.scratch import Scratch
from tests.same import rows_of, rows_of_sql

SIZES = [(7, 13), (11, 4), (1, 9), (16, 16), (3, 3)]
KEYS = ["f"]


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(3)
    return {k: rng.integers(0, 256, (2, *s)) for k, s in enumerate(SIZES)}


def tiled(spark, frames, r, side=5):
    rows = [(k, y, [int(v) for v in m[0][y]], [int(v) for v in m[1][y]]) for k, m in frames.items() for y in range(m.shape[1])]
    cut = S.tiles(spark.createDataFrame(rows, "f long, y long, a array<long>, b array<long>"), KEYS, ["a", "b"], side)
    return S.with_halo(cut, KEYS, ["a", "b"], r)


def drawn(df, frames, name, side=5):
    out = {k: np.full(m.shape[1:], np.nan) for k, m in frames.items()}
    for r in S.pixels(df, KEYS, [name], side).collect():
        assert np.isnan(out[r.f][r.y, r.x])
        out[r.f][r.y, r.x] = r[name]
    return out


def around(m, y, x, r):
    return m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]


@pytest.mark.parametrize("r", [1, 2, 5])
def test_moving_aggregates_are_clipped_at_the_frame(spark, frames, r):
    h, w, a = F.col("h"), F.col("w"), F.col("a")
    df = tiled(spark, frames, r).select("f", "ty", "tx", S.moving(a, r, h, w, S.total).alias("s"), S.moving(a, r, h, w, F.array_min).alias("m"), S.moving(a, r, h, w, S.present, S.total).alias("n"))
    for name, how in (("s", np.sum), ("m", np.min), ("n", np.size)):
        got = drawn(df, frames, name)
        for k, f in frames.items():
            want = [[how(around(f[0], y, x, r)) for x in range(f.shape[2])] for y in range(f.shape[1])]
            assert (got[k] == np.array(want)).all()


def test_gradient_nearest_and_morphology(spark, frames):
    h, w = F.col("h"), F.col("w")
    one, two = tiled(spark, frames, 1), tiled(spark, frames, 2)
    bits = F.transform("a", lambda row: F.transform(row, lambda v: (v >= 90).cast("int")))
    two = two.withColumn("m", bits).withColumn("e", S.eroded(F.col("m"), h + 2, w + 2)).withColumn("d", S.dilated(F.col("m"), h + 2, w + 2))
    got = {
        "g": drawn(one.select("f", "ty", "tx", S.sobel(F.col("a"), h, w).alias("g")), frames, "g"), "n": drawn(one.select("f", "ty", "tx", S.nearest(F.col("a"), F.col("b"), h, w).alias("n")), frames, "n"),
        "o": drawn(two.select("f", "ty", "tx", S.dilated(F.col("e"), h, w).alias("o")), frames, "o"), "c": drawn(two.select("f", "ty", "tx", S.eroded(F.col("d"), h, w).alias("c")), frames, "c"),
    }
    for k, (a, b) in frames.items():
        hh, ww = a.shape
        m = (a >= 90).astype(int)
        ero = lambda m: np.array([[around(m, y, x, 1).min() if 0 < y < hh - 1 and 0 < x < ww - 1 else 0 for x in range(ww)] for y in range(hh)])  # noqa: E731, B023
        dil = lambda m: np.array([[around(m, y, x, 1).max() for x in range(ww)] for y in range(hh)])  # noqa: E731, B023
        assert (got["o"][k] == dil(ero(m))).all() and (got["c"][k] == ero(dil(m))).all()
        for y in range(hh):
            for x in range(ww):
                assert got["n"][k][y, x] == np.abs(a[y, x] - around(b, y, x, 1)).min()
                if 0 < y < hh - 1 and 0 < x < ww - 1:
                    s = around(a, y, x, 1)
                    gx, gy = (s[:, 2] - s[:, 0]) @ [1, 2, 1], (s[2] - s[0]) @ [1, 2, 1]
                    assert got["g"][k][y, x] == min(255, int(np.hypot(gx, gy) / 4 + 0.5))
                else:
                    assert got["g"][k][y, x] == 0


def test_only_strips_meet_tiles_that_stay(spark, frames):
    """No Python, and the tiles' own exchange is the one their making needs: the strips' side is the only other one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tiled(spark, frames, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") <= 3


def test_thresholds_from_counters_are_those_of_the_pixels(spark):
    """Against the same statistics taken from lists of values, with empty cells and frames, ties and tails."""
    s = Settings(stable_pixels=100)
    rng = np.random.default_rng(9)
    rows, cells = [], {}
    for f in range(5):
        for c in range(4):
            n = [0, 1, 2, 40, 151][(f + c) % 5]
            score = np.minimum(255, rng.gamma(2, [6, 30][f % 2], n)).astype(int)
            kind = rng.choice([0, 1, 2], n, p=[0.1, 0.3, 0.6]) if f < 4 else np.zeros(n, int)
            cells[f, c] = score, kind
            rows += [(f, c, int(v), int(k)) for v, k in zip(score, kind, strict=True)]
    df = spark.createDataFrame(rows, "f long, c long, v long, k long").repartition(3)
    counts = L.counters(df, ["f", "c"], "v", valid=F.col("k") > 0, candidates=F.col("k") > 1)
    scratch = Scratch(spark, "t")
    frames = L.frame_thresholds(scratch, counts, ["f"], s)
    got = {r.f: r for r in frames.collect()}
    local = {(r.f, r.c): r for r in L.cell_thresholds(scratch, counts, ["f"], ["c"], frames, s).collect()}
    mid = lambda v: float(np.median(v)) if len(v) else 0.0
    for f in range(5):
        score, kind = (np.concatenate([cells[f, c][k] for c in range(4)]) for k in (0, 1))
        values, cand = score[kind > 0], score[kind > 1]
        keep = lambda v: v[v <= mid(v) + s.tail_mads * max(2, mid(np.abs(v - mid(v))))]
        stable = keep(cand)
        guard = lambda v: float(np.sort(v)[int(np.floor((len(v) - 1) * (1 - s.seed_share) + 0.5))]) if len(v) else 0.0
        used = stable if len(stable) else cand if len(cand) else values
        mad = mid(np.abs(used - mid(used)))
        high = min(s.high_ceiling, max(s.high_floor, mid(used) + s.high_mads * max(2, mad), guard(values)))
        low = min(max(s.low_floor, high - 1), max(s.low_floor, high * s.low_share, mid(used) + s.low_mads * max(2, mad)))
        r = got[f]
        assert (r.valid_pixels, r.stable_pixels, r.tail_pixels) == (len(values), len(stable), len(cand) - len(stable))
        assert (r.median, r.mad, r.guard, r.high, r.low) == pytest.approx((mid(used), mad, guard(values), high, low))
        assert r.enough == (len(stable) >= max(100, int(len(values) * s.stable_share + 0.5)))
        for c in range(4):
            score, kind = cells[f, c]
            if not len(score):
                assert (f, c) not in local
                continue
            values, stable = score[kind > 0], keep(score[kind > 1])
            used = stable if len(stable) else values
            mad = mid(np.abs(used - mid(used)))
            least = max(s.high_floor, high)
            most = max(least, min(s.high_ceiling, high * s.local_high))
            h = min(most, max(least, mid(used) + s.high_mads * max(2, mad), guard(values)))
            least_low = max(s.low_floor, low * s.local_low)
            assert (local[f, c].high, local[f, c].low) == pytest.approx((h, min(max(least_low, h - 1), max(least_low, h * s.low_share, mid(used) + s.low_mads * max(2, mad)))))


def test_planes_do_not_depend_on_the_tiles(spark):
    from parcelflow.plans import thresholds

    rows = {side: sorted(tuple(r) for r in thresholds.scene_pixels(spark, "/root/testdata/sf0.001", side).where("scene_id < 3").collect()) for side in (7, 256)}
    assert rows[7] == rows[256] and len(rows[7]) > 2000


@pytest.mark.parametrize("name", ["noise_thresholds", "robust_stats", "local_thresholds", "radiometric_gain", "clipped_stats"])
def test_statistics_of_frames_make_no_row_for_a_pixel(spark, name, tmp_path):
    rows = [(k, [((k * 7 + i * i) % 97 / 97 - 0.5) for i in range(n)], 0) for k, n in ((0, 64), (1, 64), (2, 64), (3, 61), (4, 64), (6, 64), (7, 0), (8, 64), (8, 64), (9, 64))]
    ids, values, labels = zip(*rows, (11, None, 0), strict=True)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert rows_of(df) == rows_of_sql(catalog.SQL[name], str(tmp_path), df.columns)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Join") == 1
