import random

import numpy as np
from pyspark.sql import functions as F

from parcelflow.operators import hamming, homography
from parcelflow.sources.scratch import Scratch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_two_nearest_codes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    near = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    train = [(k, i, near(rng.choice(base), rng.choice([0, 0, 1, 3, 6, 11]))) for k in (1, 2) for i in range(80)]
    asked = [(k, 1000 + i, near(rng.choice(base), rng.choice([0, 2, 5, 9, 20]))) for k in (1, 2) for i in range(50)] + [(3, 1, 5)]
    names = "k long, id long, code long"
    df = lambda rows: spark.createDataFrame([(k, i, signed(c)) for k, i, c in rows], names)
    got = {(r.k, r.id): r for r in hamming.matches(Scratch(spark, "t"), df(asked), df(train), ["k"], 12, 0.74).collect()}
    for k, i, c in asked:
        d = sorted(((c ^ t).bit_count(), j) for key, j, t in train if key == k)
        if not d or d[0][0] > 12:
            assert (k, i) not in got
            continue
        second = d[1] if d[1][0] <= int(12 / 0.74) else (None, None)
        r = got[k, i]
        assert (r.first_distance, r.best, r.second_distance, r.second) == (*d[0], *second)
        assert r["distinct"] == (d[0][0] < 0.74 * d[1][0])
    assert len(got) > 40


def test_wide_radii_write_no_pairs_but_those_near(spark, monkeypatch):
    rng, put, wrote = random.Random(7), Scratch.put, {}

    def counted(self, df, name="table"):
        out = put(self, df, name)
        wrote[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    monkeypatch.setattr(hamming, "SIDE", 200)
    codes = [rng.getrandbits(64) for _ in range(1200)]
    df = lambda rows: spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long")
    for most in (3, 22):
        asked = [(k, c ^ (k % 5)) for k, c in enumerate(codes[:700])]
        train = [(5000 + k, c) for k, c in enumerate(codes[600:] + codes[600:640])]
        got = {r.id: r for r in hamming.matches(Scratch(spark, "t"), df(asked), df(train), [], most, 0.74).collect()}
        want = 0
        for i, c in asked:
            d = sorted(((c ^ t).bit_count(), j) for j, t in train)[:2]
            if d[0][0] <= most:
                want += 1
                second = d[1] if d[1][0] <= int(most / 0.74) else (None, None)
                assert (got[i].first_distance, got[i].best, got[i].second_distance, got[i].second) == (*d[0], *second)
        assert len(got) == want > 50
    assert wrote["wide"] < 20 * 700  # of 700 x 600 pairs, more than a quarter lies within 29 bits


def test_codes_of_signs_and_pairs_once(spark):
    v = [1.0 if (0xF0F0F0F012345678 >> k) & 1 else -0.5 for k in range(64)]
    assert spark.createDataFrame([(v,)], "v array<double>").select(hamming.sign_code(F.col("v"))).first()[0] == signed(0xF0F0F0F012345678)
    q = spark.createDataFrame([(7,), (0,)], "q long")
    got = hamming.within(q, q.withColumnRenamed("q", "code"), [], 16, 4)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 0), (0, 7, 3), (7, 0, 3), (7, 7, 0)]
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def project(h, x, y):
    u = h @ np.array([x, y, 1.0])
    return u[:2] / u[2]


def test_votes_find_the_transform_in_spite_of_outliers(spark):
    rng = np.random.default_rng(4)
    rows, true = [], {}
    for k in range(12):
        h = np.array([[1 + rng.normal(0, 0.1), rng.normal(0, 0.1), rng.normal(0, 20)], [rng.normal(0, 0.1), 1 + rng.normal(0, 0.1), rng.normal(0, 20)], [rng.normal(0, 1e-4), rng.normal(0, 1e-4), 1]])
        true[k] = h
        for place in range(1, 41):
            x, y = rng.uniform(0, 500, 2)
            u, v = project(h, x, y)
            if place % 3 == 0:
                u, v = rng.uniform(0, 500, 2)
            rows.append((k, place, float(x), float(y), float(u), float(v)))
    rows += [(50, p, float(p), float(2 * p), 0.0, 0.0) for p in range(1, 9)] + [(51, p, 1.0 * p, 1.0, 2.0, 3.0) for p in (1, 2, 3)]
    got = {r.k: r for r in homography.vote(Scratch(spark, "t"), spark.createDataFrame(rows, "k long, place long, sx double, sy double, tx double, ty double"), ["k"]).collect()}
    assert set(got) == set(range(12))
    for k, r in got.items():
        assert r.matches == 40 and r.inliers >= 27 and r.median_error < 1e-6
        h = np.array(r.h).reshape(3, 3)
        assert np.allclose(h / h[2, 2], true[k] / true[k][2, 2], atol=1e-6)


def test_hypotheses_are_not_written_and_large_pairs_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for k, n in enumerate([3, 4, 5, 8, 9, 30, 200]):
        for place in range(1, n + 1):
            x, y = rng.uniform(0, 500, 2)
            wrong = 60.0 if place % 4 == 0 and n > 5 else 0.0
            rows.append((k, place, float(x), float(y), float(1.1 * x + 5 + wrong + rng.normal()), float(0.9 * y - 3 + rng.normal())))
    df = spark.createDataFrame(rows, "k long, place long, sx double, sy double, tx double, ty double")
    put, names = Scratch.put, []
    monkeypatch.setattr(Scratch, "put", lambda self, d, name="table": names.append(name) or put(self, d, name))

    def voted():
        return {r.k: (r["sample"], r.matches, r.inliers, round(r.median_error, 9), round(r.p95_error, 9)) for r in homography.vote(Scratch(spark, "t"), df, ["k"]).collect()}

    one = voted()
    assert set(one) == set(range(1, 7)) and names == ["chunks"]
    monkeypatch.setattr(homography, "CHUNK", 8)
    assert voted() == one and "hypotheses" in names
