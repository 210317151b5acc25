import base64
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import overlays, png
from parcelflow.operators.runs import area
from parcelflow.operators import crops, detector, evidence as E, refine, registration
from parcelflow.operators.settings import Settings, from_options, minimum_area, scale_parameters
from parcelflow.sources import annotations, models, sinks


def half(v):
    return int(np.floor(v + 0.5))


def _scene(h=60, w=70, seed=1):
    rng = np.random.default_rng(seed)
    a = np.kron(rng.integers(40, 220, (h // 10, w // 10, 3)), np.ones((10, 10, 1))).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    b[20:34, 30:50] = (250, 250, 245)
    return a, b, rng.random((h, w)) > 0.05


def around(y, x, h, w, r):
    return [(v, u) for v in range(max(0, y - r), min(h, y + r + 1)) for u in range(max(0, x - r), min(w, x + r + 1))]


def brute_mean(p, valid, r):
    h, w = valid.shape
    out = np.zeros((h, w))
    for y, x in itertools.product(range(h), range(w)):
        if valid[y, x]:
            n = [p[q] for q in around(y, x, h, w, r) if valid[q]]
            out[y, x] = half(sum(map(float, n)) / max(1, len(n)))
    return out


def brute_directed(a, b, valid, r):
    h, w = valid.shape
    out = np.zeros((h, w))
    for y, x in itertools.product(range(h), range(w)):
        if valid[y, x]:
            out[y, x] = half(min([255.0, *(float(np.abs(b[y, x].astype(float) - a[q].astype(float)).mean()) for q in around(y, x, h, w, r) if valid[q])]))
    return out


def test_kernels_equal_brute_force():
    a, b, valid = (x[12:38, 22:55] for x in _scene())
    ga, gb = registration.gray(a), registration.gray(b)
    assert (E.box_mean(ga, valid, 3) == brute_mean(ga, valid, 3)).all()
    for r in (0, 1, 2):
        assert (E.directed(a, b, valid, r) == brute_directed(a, b, valid, r)).all()
    one, two = brute_directed(ga, gb, valid, 2), brute_directed(gb, ga, valid, 2)
    want = np.vectorize(half)(0.6 * np.maximum(one, two) + 0.2 * (one + two)) * valid
    assert (E.symmetric(ga, gb, valid, 2) == want).all()
    h, w = valid.shape
    low = np.array([[min([ga[y, x], *(ga[q] for q in around(y, x, h, w, 1) if valid[q])]) if valid[y, x] else 0 for x in range(w)] for y in range(h)])
    assert (E.least(ga, valid, 1) == low).all()
    ss = E.ssim(ga, gb, valid, 2)
    for y, x in ((0, 0), (5, 7), (20, 30), (25, 3)):
        if valid[y, x]:
            q = around(y, x, h, w, 2)
            u, v = np.array([float(ga[p]) for p in q]), np.array([float(gb[p]) for p in q])
            value = (2 * u.mean() * v.mean() + 6.5025) * (2 * ((u * v).mean() - u.mean() * v.mean()) + 58.5225) / ((u.mean() ** 2 + v.mean() ** 2 + 6.5025) * (u.var() + v.var() + 58.5225))
            assert ss[y, x] == half(min(255, max(0, (1 - value) / 1.2 * 255)))
    c, st, t, m = (np.array([[v]], float) for v in (40, 120, 30, 200))
    s = 120 / 255
    assert E.combined(c, st, t, m, np.ones((1, 1), bool))[0, 0] == half(255 * max(0.45 * 40 / 64 + 0.4 * s + 0.15 * 30 / 96, 200 / 255 * 0.7 + 0.12 * s + 0.04 * 30 / 96))
    assert E.combined(np.array([[5.0]]), np.array([[30.0]]), t, np.zeros((1, 1)), np.ones((1, 1), bool))[0, 0] == half(255 * 0.18 * (0.45 * 5 / 64 + 0.4 * 30 / 255 + 0.15 * 30 / 96))
    assert (E.direct(a, b) == np.abs(a.astype(int) - b).max(axis=2)).all()


def test_tiles_give_the_planes_of_the_whole_image():
    a, b, valid = _scene()
    whole = E.tile(a, b, valid, 2)
    s = Settings(tile_size=24, tile_overlap=8)
    parts = E.planes(a, b, valid, 2, s)
    assert all((whole[k] == parts[k]).all() for k in E.PLANES)
    assert whole["removal"].max() <= 255 and whole["structure"][valid].max() > 100


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.45, 0.6):
        m = rng.random((37, 41)) < share
        want, n = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                want[y, x] = n
                while todo:
                    v, u = todo.pop()
                    for q in around(v, u, *m.shape, 1):
                        if m[q] and not want[q]:
                            want[q] = n
                            todo.append(q)
        got, k = E.label(m)
        assert k == n and (got == want).all()
        box = E.boxes(got, k)
        for j in range(k):
            y, x = np.nonzero(got == j + 1)
            assert box[j].tolist() == [x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x)]
    assert E.label(np.zeros((3, 4), bool))[1] == 0
    ring = np.ones((7, 7), bool)
    ring[3, 3] = ring[0, 6] = False
    assert E.without_holes(ring, 1)[3, 3] and not E.without_holes(ring, 1)[0, 6] and not E.without_holes(ring, 0)[3, 3]
    snake = np.zeros((400, 400), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert E.label(snake)[1] == 1


def test_morphology_bands_and_provisional_pixels():
    m = np.zeros((9, 9), bool)
    m[3:6, 3:6] = True
    assert E.erode(m, 1).sum() == 1 and E.dilate(m, 1).sum() == 25 and (E.dilate(E.erode(m, 1), 1) == m).all()
    assert len(E.disk(2)) == 21
    d, g = np.zeros((20, 30), int), np.zeros((20, 30), int)
    d[:, :4] = 30
    d[:, 15:18] = 30  # not at the border
    d[17:] = 30
    got = E.bands(d, g)
    assert got[:, :4].all() and got[17:].all() and not got[:17, 4:].any()
    g[:, :4] = 50
    assert not E.bands(d, g)[:17, :4].any()
    score = np.zeros((12, 12), int)
    score[5, 5:9] = 30
    score[6, 5] = 12
    likely = E.provisional(score, np.zeros_like(score), np.zeros_like(score), np.ones(score.shape, bool))
    want = np.zeros(score.shape, bool)
    for y, x in itertools.product(range(1, 11), range(1, 11)):
        want[y, x] = score[y, x] >= 24 and (score[y - 1 : y + 2, x - 1 : x + 2] >= 10).sum() >= 4
    assert (likely == E.dilate(want, 2)).all()


def test_thresholds_settings_and_scales():
    rng = np.random.default_rng(2)
    shape = (120, 140)
    zero = np.zeros(shape)
    p = {"score": rng.integers(0, 9, shape).astype(float), "in_view": np.ones(shape, bool), "valid": np.ones(shape, bool), "before_gradient": zero, "after_gradient": zero, "registration": zero, "likely": zero > 0, "structure": zero, "color": zero}
    p["valid"][:10], p["before_gradient"] = False, zero.copy()
    p["before_gradient"][20:30] = 90
    t = E.thresholds(p)
    stable = p["score"][p["valid"] & (p["before_gradient"] <= 38)]
    med = np.median(stable)
    mad = np.median(np.abs(stable - med))
    assert t["high"] == max(24, med + 6 * max(2, mad)) and t["low"] == max(10, 0.45 * t["high"], med + 3 * max(2, mad)) and t["invalid_overlap"] == 1400 and t["strong_gradient"] == 1400 and t["enough"]
    low, high = E.local_thresholds(p, t)
    assert (high >= half(t["high"])).all() and (high <= half(1.35 * t["high"])).all() and (low >= 10).all()
    assert scale_parameters(None) == {"known": False, "closing": 1, "opening": 1, "displacement": 2, "hole": 16}
    assert scale_parameters(0.25) == {"known": True, "closing": 2, "opening": 1, "displacement": 2, "hole": 64}
    assert minimum_area(None) == 512 and minimum_area(0.5) == 24 and minimum_area(5.0) == 4
    s = from_options({"accept": "1.7", "tile_size": "10", "ssim_radius": "x", "displacement_m": "-3", "high_floor": "30.6"})
    assert (s.accept, s.tile_size, s.ssim_radius, s.displacement_m, s.high_floor) == (1.0, 256, 5, 0.0, 31)
    assert E.clipped(np.arange(100.0))[0] == 49.5 and E.clipped(np.array([]))[1] == 1.0


def test_radiometry_brings_a_darker_image_back():
    rng = np.random.default_rng(3)
    a = np.clip(rng.normal(128, 8, (40, 50, 3)), 0, 255).astype(np.uint8)
    b = np.clip(a * 0.8 + 12, 0, 255).astype(np.uint8)
    out, raw = E.normalized(a, b, np.ones((40, 50), bool))
    assert raw > 10 and np.abs(out.astype(int) - a).mean() < 2
    assert (E.normalized(a, b, np.zeros((40, 50), bool))[0] == b).all()


def _pairs(spark):
    h, w = 200, 260
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([110 + 8 * np.sin(x / 31), 120 + 8 * np.cos(y / 27), 100 + 0 * x], axis=2) + rng.normal(0, 2, (h, w, 3))
    before = np.clip(base, 0, 255).astype(np.uint8)
    after = np.clip(base + rng.normal(0, 2, base.shape), 0, 255).astype(np.uint8)
    after[80:120, 100:150] = (245, 240, 235)
    same = np.clip(base + rng.normal(0, 2, base.shape), 0, 255).astype(np.uint8)
    full, none = np.full((h, w), 255, np.uint8).tobytes(), bytes(h * w)
    row = lambda i, b, ok, mpp: (i, w, h, before.tobytes(), b.tobytes(), full, none, none, [0.0] * 16, mpp, ok)
    return spark.createDataFrame([row(1, after, True, 0.5), row(2, same, True, None), row(3, after, False, 0.5), row(4, after, None, None)], "pair_id long, width int, height int, before binary, after binary, valid binary, edge_residual binary, registration binary, grid array<double>, mpp double, reliable boolean")


def test_detector_finds_a_new_building_and_nothing_else(spark):
    regions, rows = detector.detect(_pairs(spark), Settings(tile_size=256, stable_pixels=100))
    got = {r.pair_id: r for r in rows.collect()}
    assert got[3].state == got[4].state == "REGISTRATION_UNRELIABLE" and got[3].low is None and got[3].warnings == []
    assert got[2].n_accepted + got[2].n_review == 0 and got[2].state in ("NO_DIFFERENCE_EVIDENCE", "EVIDENCE_BELOW_THRESHOLD", "COMPONENTS_REJECTED")
    assert got[1].state.startswith("CHANGES") and got[1].known_scale and got[1].exclusions["invalid_overlap"] == 0
    kept = regions.where("state <> 'rejected'").persist()
    found = kept.collect()
    assert {r.pair_id for r in found} == {1} and len(found) == 1
    r = found[0]
    assert abs(r.left - 100) <= 4 and abs(r.top - 80) <= 4 and abs(r.width - 50) <= 8 and abs(r.height - 40) <= 8 and r.area_m2 == r.pixel_area * 0.25 and r.region_id in ("R1", "V1") and len(r.polygon) >= 4
    mask = detector.state_mask(kept, ("accepted", "needs_review"))
    assert mask.agg(area()).first()[0] == r.pixel_area and mask.agg(F.min("y0")).first()[0] == r.top
    shown = kept.select("pair_id", "region_id", "state", F.lit("pixel_mask").alias("geometry_type"), F.col("polygon").alias("ring"), "left", "top", "width", "height")
    drawn = json.loads(overlays.combined(shown).first().geojson)
    line = drawn["features"][0]["geometry"]["coordinates"][0]
    assert drawn["features"][0]["properties"]["label"] == r.region_id and line[0] == line[-1] and overlays.rejected(shown).count() == 0
    box = json.loads(overlays.candidates(shown).first().geojson)["features"][0]["geometry"]["coordinates"][0]
    assert box[0] == [r.left, r.top] and box[2] == [r.left + r.width, r.top + r.height]
    assert detector.detect(_pairs(spark).limit(0))[1].count() == 0


def test_alignment_cells_and_borders():
    h = w = 80
    valid, likely, zero = np.ones((h, w), bool), np.zeros((h, w), bool), np.zeros((h, w))
    grad = np.full((h, w), 60)
    lone = np.zeros((h, w))
    lone[:20, :20] = 255
    raw = np.zeros(16)
    raw[[10, 11, 15, 4]] = 0.9
    cells, mask = E.unreliable(lone, np.full((h, w), 99), grad, zero, likely, valid, raw)
    assert {(r, c): why for r, c, _, _, why in cells} == {(0, 0): "STABLE_EDGE_RESIDUAL_HIGH", (2, 2): "ADJACENT_SEVERE_RAW_RESIDUAL", (2, 3): "ADJACENT_SEVERE_RAW_RESIDUAL", (3, 3): "ADJACENT_SEVERE_RAW_RESIDUAL"}
    assert mask[:20, :20].all() and mask.sum() == 4 * 400
    member = np.zeros((6, 7), bool)
    member[1:5, 1:6] = True
    ok = np.ones((6, 7), bool)
    ok[:, 0] = False
    assert detector.borders(member, ok) == (18, 14 / 20, 4 / 14)
    assert detector.stability(np.full(10, 200.0), 50, 150) == pytest.approx(1.0)


def test_keypoints_placeholders_and_annotations(spark, tmp_path):
    points = spark.createDataFrame([(1, 2.0, 3.0, True), (1, 1.0, 5.0, False)], "pair_id long, x double, y double, inlier boolean")
    assert [f["geometry"]["coordinates"] for f in json.loads(overlays.keypoints(points).first().geojson)["features"]] == [[1.0, 5.0], [2.0, 3.0]]
    url = spark.range(1).select(overlays.placeholder(F.lit("a<b"), F.lit(True)).alias("u")).first().u
    assert url.startswith("data:image/svg+xml;base64,")
    doc = {"schemaVersion": "1.0", "id": "p", "images": {"oldPath": "o", "currentPath": "c"}, "positives": [{"id": "x", "changeClass": "b", "polygon": [[1, 1], [5, 1], [5, 4], [1, 4]]}, {"id": "y", "uncertain": True}, {"id": "z", "polygon": [[-5, -5], [-4, -5], [-4, -3]]}], "unreviewedPolicy": "ignore"}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    a = annotations.read(spark, f"file://{tmp_path}/a.json", (None, "new"))
    assert a.first().images.currentPath == "new" and a.first().images.oldPath == "o"
    objects = annotations.positives(a)
    assert {r.object_id for r in objects.collect()} == {"x", "z"}
    px = {(r.y, r.x) for r in annotations.rasterized(objects, ["object_id"], 20, 20).collect()}
    assert px == set(itertools.product(range(1, 4), range(1, 5)))
    ring = annotations.region_ring(F.lit(None).cast("array<struct<x:double,y:double>>"), F.lit(2), F.lit(3), F.lit(2), F.lit(1))
    assert annotations.rasterized(spark.range(1).select("id", ring.alias("ring")), ["id"], 9, 9).count() == 2


def test_refinement_takes_the_evidence_near_a_box(spark):
    h, w = 90, 120
    rng = np.random.default_rng(9)
    p = {k: rng.integers(0, 40, (h, w)).astype(np.uint8) for k in ("score", "structure", "color", "edge")}
    low = np.zeros((h, w), np.uint8)
    low[30:42, 40:60] = low[50:52, 5:8] = low[33:36, 62:64] = 255
    for k in p:
        p[k][30:42, 40:60] = 120
    p["low"] = low
    pairs = spark.createDataFrame([(1, w, h, 50.0, *(p[k].tobytes() for k in ("low", "score", "structure", "color", "edge")))], "pair_id long, frame_width int, frame_height int, low_threshold double, low binary, score binary, structure binary, color binary, edge binary")
    boxed = spark.createDataFrame([(1, 1, 45, 28, 30, 12), (1, 2, 4, 48, 10, 10), (1, 3, 90, 5, 20, 20), (2, 4, 0, 0, 5, 5)], "pair_id long, proposal_id long, left int, top int, width int, height int")
    got = {r.proposal_id: r for r in refine.refine(boxed, pairs).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.geometry, r.left, r.top, r.width, r.height, r.pixels) == ("pixel_mask", 40, 30, 24, 12, 246) and sum(r.support) == 246
    y, x = np.nonzero(low[:, :70])
    keep = y < 45
    assert r.mean_score == pytest.approx((p["score"][y[keep], x[keep]] / 255).mean()) and r.color_support == pytest.approx((p["color"][y[keep], x[keep]] / 64).mean())
    assert (got[2].geometry, got[2].left, got[2].support, got[2].pixels) == ("frontier_bbox", 4, None, 6) and got[3].pixels == 0 and got[3].mean_score == 0


def test_model_calls_become_rows(spark):
    def call(request):
        if request["id"] == 2:
            raise TimeoutError("slow")
        if request["id"] == 3:
            raise ValueError("x" * 500)
        return {"decision": "uncertain", "of": request["name"]}

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    got = {r.id: r for r in models.answers(rows, call).collect()}
    assert (got["1"].status, json.loads(got["1"].response)["of"], got["1"].attempts) == ("completed", "a", 1)
    assert (got["2"].status, got["2"].attempts, got["2"].error) == ("timed_out", 3, "slow") and (got["3"].status, got["3"].attempts, len(got["3"].error)) == ("failed", 1, 300)


def test_native_promotion_and_swapped_sides(spark):
    rng = np.random.default_rng(6)
    a = np.kron(rng.integers(0, 256, (12, 16, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))
    h, w = a.shape[:2]
    small = [1.0, 0.0, 4.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0]  # between images of half the size
    kind = "pair_id long, old_rgb binary, old_width int, old_height int, current_rgb binary, current_width int, current_height int, homography array<double>, old_scale double, current_scale double"
    pairs = spark.createDataFrame([(1, a.tobytes(), w, h, a.tobytes(), w, h, small, 0.5, 0.5)], kind)
    out = np.frombuffer(registration.promoted(pairs).first().warped, np.uint8).reshape(h, w, 3)
    assert (out[4:, 8:] == a[:-4, :-8]).all()
    other = registration.swapped(pairs.withColumn("current_width", F.lit(7)))
    assert other.first().old_width == 7 and other.first().current_width == w and other.columns == pairs.columns


def test_crops(spark):
    a = np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3)
    rows = spark.createDataFrame([(1, "x", 8, 6, 2, 1, 3, 2, a.tobytes()), (1, "y", 8, 6, 9, 1, 3, 2, a.tobytes())], "pair_id long, id string, frame_width int, frame_height int, left int, top int, width int, height int, data binary")
    got = {r.id: r.url for r in crops.image_crops(rows).collect()}
    assert got["y"] is None and (png.decode(base64.b64decode(got["x"].split(",")[1])) == a[1:3, 2:5]).all()
    plane = spark.createDataFrame([(1, "x", 8, 6, 0, 0, 8, 6, a[..., 0].tobytes())], rows.schema)
    assert (png.decode(base64.b64decode(crops.plane_crops(plane).first().url.split(",")[1]))[..., 0] == a[..., 0]).all()
    mask = spark.createDataFrame([(1, "x", 4, 5, 2, 2, 3, 5, 4, 3, bytes([1, 0, 1, 1]))], "pair_id long, id string, left int, top int, width int, height int, crop_left int, crop_top int, crop_width int, crop_height int, support binary")
    want = np.zeros((3, 4), int)
    want[0, 1] = want[1, 1] = want[1, 2] = 255
    assert (png.decode(base64.b64decode(crops.mask_crops(mask).first().url.split(",")[1]))[..., 0] == want).all()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', None), (2, "", "x,y")], "id long, name string, note string")
    sinks.write_csv(rows.coalesce(1), f"file://{tmp_path}/c", ["id", "name", "note"])
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text == '"id","name","note"\n"1","a ""b""",""\n"2","","x,y"\n'
    sinks.write_json(rows.coalesce(1), f"file://{tmp_path}/j")
    assert json.loads(next((tmp_path / "j").glob("*.json")).read_text().splitlines()[0]) == {"id": 1, "name": 'a "b"', "note": None}
    assert sinks.DebugRun(f"file://{tmp_path}/d").stage(rows, "x") is rows and not (tmp_path / "d").exists()
    assert sinks.DebugRun(f"file://{tmp_path}/d", True).stage(rows, "x").count() == 2 and len(list((tmp_path / "d").iterdir())) == 1
    kind = "parcel_id string, owner_name string, area_m2 double, lat double, lng double, polygon array<struct<lat:double,lng:double>>"
    new = spark.createDataFrame([("p1", "o", 5.0, 10.0, 20.0, None), ("p2", " ", 5.0, 10.0, 200.0, None), ("p1", "o", 5.0, 10.0, 20.0, None)], kind)
    bad = sinks.insert_parcels(new, f"file://{tmp_path}/parcels")
    assert [(r.parcel_id, r.errors) for r in bad.collect()] == [("p2", ["owner_name", "lng"])]
    sinks.insert_parcels(new, f"file://{tmp_path}/parcels")
    assert spark.read.parquet(f"file://{tmp_path}/parcels").count() == 1
    later = spark.createDataFrame([("p1", "other", 9.0, 1.0, 2.0, None), ("p3", "z", 5.0, 1.0, 2.0, None), ("p3", "a", 7.0, 1.0, 2.0, None)], kind)
    for _ in range(2):
        sinks.insert_parcels(later, f"file://{tmp_path}/parcels", "1")
    stored = sorted(sinks.stored(spark, f"file://{tmp_path}/parcels", kind, "parcel_id").collect())
    assert [(r.parcel_id, r.owner_name) for r in stored] == [("p1", "o"), ("p3", "a")] and spark.read.parquet(f"file://{tmp_path}/parcels").count() == 2
    patch = lambda *rows: spark.createDataFrame(list(rows), "id long, status string")
    for batch, rows in (("a", [(1, "NEW"), (2, "NEW")]), ("b", [(1, "RESOLVED"), (1, "NEW")]), ("b", [(1, "RESOLVED"), (1, "NEW")])):
        sinks.upsert(patch(*rows), "id", f"file://{tmp_path}/status", batch)
    got = sinks.stored(spark, f"file://{tmp_path}/status", "id long, status string", "id", newest=True)
    assert sorted(map(tuple, got.collect())) == [(1, "NEW"), (2, "NEW")] and spark.read.parquet(f"file://{tmp_path}/status").count() == 3
    assert len(stored) == 2 and stored[0].polygon[0].lat == pytest.approx(10 - 0.00035) and len(stored[0].polygon) == 4
    assert sinks.truncate(spark, f"file://{tmp_path}/db", {"parcels": kind, "alerts": "id long"}) == ["alerts", "parcels"] and spark.read.parquet(f"file://{tmp_path}/db/parcels").count() == 0
