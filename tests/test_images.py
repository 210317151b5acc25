import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import png
from parcelflow.operators import shapes, tiles
from parcelflow.sources import images
from parcelflow.streaming import alerts


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3)):
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(a)) == a.reshape(shape[0], shape[1], -1)).all()
    with pytest.raises(ValueError):
        png.decode(b"no image")


def test_heat_ends():
    assert png.heat(np.array([0, 255])).tolist() == [[0, 0, 180], [255, 0, 0]]


@pytest.fixture
def uploads(tmp_path):
    a = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    for pair, names in {"p1": ("oldImage.png", "currentImage.png"), "p2": ("oldImage.png",), "p3": ("oldImage.png", "currentImage.txt")}.items():
        (tmp_path / pair).mkdir()
        for n in names:
            (tmp_path / pair / n).write_bytes(png.encode(a))
    return tmp_path, a


def test_upload_pairs(spark, uploads):
    got = {r.pair_id: (r.status, r.error) for r in images.upload_pairs(spark, f"file://{uploads[0]}").collect()}
    assert got == {"p1": (200, None), "p2": (400, "Both oldImage and currentImage are required."), "p3": (400, "Use PNG, JPEG, WebP, or GIF images.")}


def test_decoded_files(spark, uploads):
    r = images.decoded(spark, f"file://{uploads[0]}/p1", 4).orderBy("path").first()
    assert (r.width, r.height, r.analysis_width, r.analysis_height) == (5, 4, 4, 3)
    assert bytes(r.rgb) == uploads[1].tobytes()
    flat = np.full((9, 6, 3), 77, np.uint8)
    assert (images.resized(flat, 4) == 77).all() and images.resized(flat, 9) is flat


def test_data_urls_and_masks(spark):
    plane = np.array([[0, 3], [0, 0]], np.uint8)
    url = png.data_url(png.encode(plane))
    rows = spark.createDataFrame([(url,), ("HTTPS://a/b.png",), ("ftp://a",), (None,), ("data:image/png;base64,AAAA",)], "u string")
    got = images.masks(rows.select(images.is_image_source(F.col("u")).alias("ok"), images.data_url_bytes(F.col("u")).alias("raw")), "raw").collect()
    assert [r.ok for r in got] == [True, True, False, False, True]
    assert bytes(got[0].mask) == bytes([0, 255, 0, 0]) and all(r.mask is None for r in got[1:])


def test_limits(spark):
    rows = spark.createDataFrame([(1, 1), (0, 5), (10_001, 1), (6000, 4001), (None, 1)], "w int, h int")
    assert [r[0] for r in rows.select(images.within_limits(F.col("w"), F.col("h"))).collect()] == [True, False, False, False, False]


def test_tiles_give_what_the_whole_image_gives(spark):
    def blurred(a):
        p = np.pad(a.astype(int), 2)
        return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5)) // 25

    a = np.random.default_rng(2).integers(0, 256, (37, 53), dtype=np.uint8)
    df = spark.createDataFrame([(1, 53, 37, bytearray(a.tobytes()))], "image_id long, width int, height int, data binary")
    r = tiles.tiled(df, blurred, 2, core=16).first()
    assert bytes(r.data) == blurred(a).astype(np.uint8).tobytes()
    labels = tiles.grid_labels(df).collect()
    assert len(labels) == 100 and {"A0", "J9"} <= {x.label for x in labels}


def _pixels(mask, score):
    y, x = np.nonzero(mask)
    return pd.DataFrame({"pair_id": 1, "component": 1, "y": y, "x": x, "score": score[y, x]})


def test_weakly_joined_blocks_are_split(spark):
    mask, score = np.zeros((120, 240), bool), np.zeros((120, 240), int)
    mask[30:80, 20:50], mask[30:80, 180:210], mask[54:56, 50:180] = True, True, True
    score[mask], score[54:56, 50:180] = 230, 90
    rows = spark.createDataFrame(_pixels(mask, score).astype("int64"))
    got = shapes.split_components(rows, 184).groupBy("part").count().collect()
    assert sum(r["count"] >= 800 for r in got) == 2 and sum(r["count"] for r in got) == int(mask.sum())
    assert shapes.split(_pixels(mask[:, :60], score), 184)["part"].eq(1).all()


def test_polygon_of_a_rectangle_and_a_dot(spark):
    mask = np.zeros((60, 80), bool)
    mask[10:50, 20:70] = True
    rows = spark.createDataFrame(_pixels(mask, mask.astype(int)).astype("int64"))
    r = shapes.polygons(rows).first()
    assert r.area == 2000 and sorted(map(tuple, r.polygon)) == [(20, 10), (20, 49), (69, 10), (69, 49)]
    assert shapes.outline(np.ones((1, 1))) == [(0, 0)]
    assert shapes.outline(np.ones((1, 3))) == [(0, 0), (1, 0), (2, 0), (1, 0)]


def test_stream_counts_equal_those_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", k) for d in (1, 2, 2, 9) for k in ("a", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = alerts.counts(alerts.source(spark, f"{tmp_path}/in", "ts timestamp, event_type string"))
    alerts.start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = {tuple(r) for r in alerts.counts(rows).collect()}
    assert closed == {r for r in table if r[0].day < 7} and len(closed) == 4
