import numpy as np

from parcelflow.operators import registration as reg


def _scene(h=120, w=160, seed=3):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (h // 8, w // 8, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))


def test_viewport_drops_a_dark_panel_and_bar():
    rgb = np.full((300, 400, 3), 200, np.uint8)
    assert reg.viewport(rgb) == (400, 300)
    rgb[:, 380:] = 20
    assert reg.viewport(rgb) == (380, 300)
    rgb[285:] = 20
    assert reg.viewport(rgb) == (380, 285)
    rgb[:, 200:] = 20  # the search ends at 88 % of the width
    assert reg.viewport(rgb)[0] == 352
    rgb = np.full((300, 400, 3), 200, np.uint8)
    rgb[:, 397:] = 20  # a short run at the edge is forgotten at the bright column
    assert reg.viewport(rgb) == (400, 300)


def test_masks():
    m = reg.feature_mask(100, 100)
    assert not m[:11].any() and m[50, 50] and not m[95:].any() and not m[50, 96]
    assert not reg.feature_mask(100, 100, 40, 60)[:, 40:].any() and reg.feature_mask(100, 100, 40, 60)[50, 39]


def test_warp_by_shift_and_scale():
    a, full = _scene(), np.ones((120, 160), bool)
    shift = np.array([[1, 0, 5], [0, 1, -3], [0, 0, 1]], float)
    out, valid = reg.warped(a, full, shift, 160, 120)
    assert (out[:117, 5:] == a[3:, :155]).all() and not valid[:, :5].any() and not valid[117:].any() and valid[:117, 5:].all()
    same, all_valid = reg.warped(a, full, np.eye(3), 160, 120)
    assert (same == a).all() and all_valid.all()
    native = reg.scaled(shift, (0.5, 0.5), (0.5, 0.5))
    assert np.allclose(native, [[1, 0, 10], [0, 1, -6], [0, 0, 1]])
    square = (10, 10)
    assert reg.sane(np.eye(3), square, square) and not reg.sane(np.diag([2.0, 2.0, 1.0]), square, square)
    assert not reg.sane(np.array([[1, 0, 0], [0, 1, 0], [0.2, 0, 1.0]]), square, square)
    assert reg.scale_ratio(np.diag([2.0, 0.5, 1.0]), (10, 10), (10, 10)) == 1.0


def _brute(a, b, valid):
    h, w = valid.shape
    ga, gb = reg.gray(a), reg.gray(b)

    def edges(g):
        out = np.zeros((h, w), int)
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                n = g[y - 1 : y + 2, x - 1 : x + 2]
                gx, gy = (n * [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]).sum(), (n * [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]).sum()
                out[y, x] = min(255, int(np.hypot(gx, gy) / 4 + 0.5))
        return out >= 42

    ea, eb = edges(ga), edges(gb)
    residual, lone = np.zeros((h, w), int), np.zeros((h, w), bool)
    for y, x in np.argwhere(valid):
        s = np.s_[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
        v = valid[s]
        lone[y, x] = (ea[y, x] and not (eb[s] & v).any()) or (eb[y, x] and not (ea[s] & v).any())
        tone = int((np.abs(gb[s][v] - ga[y, x]).min() + np.abs(ga[s][v] - gb[y, x]).min()) / 2 + 0.5)
        residual[y, x] = max(255 * lone[y, x], min(255, 3 * tone))
    return residual, lone


def test_residuals_equal_those_of_a_loop():
    a, b = _scene(32, 40, 1), _scene(32, 40, 2)
    valid = np.random.default_rng(4).random((32, 40)) < 0.8
    got, (residual, lone) = reg.residuals(a, b, valid), _brute(a, b, valid)
    assert (got["residual"] == residual).all() and ((got["edge_residual"] > 0) == lone).all() and lone.any()
    assert sum(c["valid_pixels"] for c in got["grid"]) == valid.sum()
    same = reg.residuals(a, a, valid)
    assert same["edge_alignment"] == 0 and not same["residual"].any() and not same["parallax"]
    assert reg.adjacent({(0, 0), (1, 0)}) and not reg.adjacent({(0, 0), (1, 1)})


def test_pairs_are_aligned_and_graded(spark):
    a = _scene()
    shifted = np.roll(a, (3, -5), axis=(0, 1))
    size = "old_rgb binary, old_width int, old_height int, current_rgb binary, current_width int, current_height int, homography array<double>"
    image = lambda h: (bytearray(a.tobytes()), 160, 120, bytearray(shifted.tobytes()), 160, 120, h)
    rows = [(1, *image([float(v) for v in (1, 0, 5, 0, 1, -3, 0, 0, 1)])), (2, *image(None)), (3, *image([0.0] * 9)), (4, *image(np.eye(3).ravel().tolist()))]
    got = reg.align(spark.createDataFrame(rows, f"pair_id long, {size}"))
    features = spark.createDataFrame([(i, 80, 60, 0.75, 0.4, 0.4, 1.2) for i in (1, 2, 3)] + [(4, None, None, None, None, None, None)], "pair_id long, matches int, inliers int, inlier_ratio double, coverage double, median_error double, p95_error double")
    graded = {r.pair_id: r for r in reg.grade(got.join(features, "pair_id")).collect()}
    inner = np.frombuffer(graded[1].residual, np.uint8).reshape(120, 160)[:115, 8:]  # at the warped frame's border its black surroundings make edges
    assert graded[1].edge_alignment < 0.01 and not inner.any() and graded[1].scale_ratio == 1 and graded[1].reliable
    for k in (2, 3):
        assert graded[k].failed == ["features", "residual", "overlap", "scale"] and not graded[k].reliable and not any(graded[k].valid) and graded[k].grid == []
    assert set(graded[4].failed) >= {"features", "reprojection"} and graded[4].edge_alignment > 20 * graded[1].edge_alignment
    assert graded[1].confidence > 0.9 > graded[2].confidence >= 0
