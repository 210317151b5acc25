"""Boxes, polygons, homographies and spatial joins of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import boxes as B
from parcelflow.operators.runs import of_rings
from parcelflow.plans.registry import query
from parcelflow.sources import tables as T

WITH = f"WITH {T.SQL}\n"
FRAME = 1000
CELL = 250


@query("default_polygon_area", WITH + """
SELECT parcel_id, round(abs((x0 * y0 - x1 * y0) + (x1 * y1 - x1 * y0) + (x1 * y1 - x0 * y1) + (x0 * y0 - x0 * y1)) / 2, 4) AS area
FROM (SELECT parcel_id, gps_lat_e4 - 3.5::DOUBLE AS y0, gps_lat_e4 + 3.5::DOUBLE AS y1, parcel_key % 90 - 3.5::DOUBLE AS x0, parcel_key % 90 + 3.5::DOUBLE AS x1 FROM parcels)""")
def default_polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """A square ring around a point, and its shoelace area."""
    x, y = F.col("parcel_key") % 90, F.col("gps_lat_e4")
    ring = F.array(*(F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((-3.5, -3.5), (3.5, -3.5), (3.5, 3.5), (-3.5, 3.5))))
    return T.parcels(spark, d).select("parcel_id", F.round(B.shoelace(ring), 4).alias("area"))


@query("box_convert", WITH + """
SELECT pair_id, proposal_id, top * 100.0::DOUBLE / 1000 AS y_pct, height * 100.0::DOUBLE / 1000 AS h_pct, greatest(0, top - 8) AS pad_top, least(1000, top + height + 8) - greatest(0, top - 8) AS pad_height,
  least(100.0, 10 + (top * 100.0::DOUBLE / 1000) * 0.4) AS full_y, least(100.0::DOUBLE - least(100.0, 10 + (top * 100.0::DOUBLE / 1000) * 0.4), (height * 100.0::DOUBLE / 1000) * 0.4) AS full_h, "left" * 100.0::DOUBLE / 1000 AS x_pct, width * 100.0::DOUBLE / 1000 AS w_pct, greatest(0, "left" - 8) AS pad_left, least(1000, "left" + width + 8) - greatest(0, "left" - 8) AS pad_width,
  least(100.0, 20 + ("left" * 100.0::DOUBLE / 1000) * 0.5) AS full_x, least(100.0::DOUBLE - least(100.0, 20 + ("left" * 100.0::DOUBLE / 1000) * 0.5), (width * 100.0::DOUBLE / 1000) * 0.5) AS full_w FROM proposals""")
def box_convert(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to percent, padding inside the frame, and crop-relative percent to full percent (crop at 20, 10, half as wide and 0.4 as high)."""
    y, h = F.col("top") * F.lit(100.0) / FRAME, F.col("height") * F.lit(100.0) / FRAME
    over = F.greatest(F.lit(0), F.col("top") - 8)
    down = F.least(F.lit(100.0), 10 + y * 0.4)
    x, w = F.col("left") * F.lit(100.0) / FRAME, F.col("width") * F.lit(100.0) / FRAME
    low = F.greatest(F.lit(0), F.col("left") - 8)
    full = F.least(F.lit(100.0), 20 + x * 0.5)
    return T.proposals(spark, d).select(
        "pair_id", "proposal_id", x.alias("x_pct"), w.alias("w_pct"), low.alias("pad_left"), (F.least(F.lit(FRAME), F.col("left") + F.col("width") + 8) - low).alias("pad_width"),
        full.alias("full_x"), F.least(100.0 - full, w * 0.5).alias("full_w"), y.alias("y_pct"), h.alias("h_pct"), over.alias("pad_top"), (F.least(F.lit(FRAME), F.col("top") + F.col("height") + 8) - over).alias("pad_height"),
        down.alias("full_y"), F.least(100.0 - down, h * 0.4).alias("full_h"),
    )


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = T.proposals(spark, d).select("pair_id", "proposal_id", "left", "top", "width", "height")
    return tuple(p.select("pair_id", *(F.col(c).alias(f"{s}_{c}") for c in ("proposal_id", "left", "top", "width", "height"))) for s in "ab")


_OVER = """greatest(0, least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) * greatest(0, least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top))"""


@query("box_iou_pairs", WITH + f"""
SELECT pair_id, a_id, b_id, round(o / greatest(1, aa + bb - o), 6) AS iou, round(o / greatest(1, least(aa, bb)), 6) AS containment FROM (
  SELECT a.pair_id, a.proposal_id AS a_id, b.proposal_id AS b_id, a.width * a.height AS aa, b.width * b.height AS bb, ({_OVER})::DOUBLE AS o
  FROM proposals a JOIN proposals b ON a.pair_id = b.pair_id AND a.proposal_id < b.proposal_id) WHERE o > 0""")
def box_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of one pair of images; the equi-join on the pair carries the range predicates."""
    a, b = _sides(spark, d)
    rows = a.join(b, "pair_id").where("a_proposal_id < b_proposal_id").where(B.overlap("a_", "b_") > 0)
    return rows.select("pair_id", F.col("a_proposal_id").alias("a_id"), F.col("b_proposal_id").alias("b_id"), F.round(B.iou("a_", "b_"), 6).alias("iou"), F.round(B.containment("a_", "b_"), 6).alias("containment"))


@query("best_match", WITH + f"""
SELECT pair_id, a_id, b_id FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id, a_id ORDER BY c DESC, u DESC, b_id) AS r FROM (
    SELECT pair_id, a_id, b_id, o / greatest(1, least(aa, bb)) AS c, o / greatest(1, aa + bb - o) AS u FROM (
      SELECT a.pair_id, a.proposal_id AS a_id, b.proposal_id AS b_id, a.width * a.height AS aa, b.width * b.height AS bb, ({_OVER})::DOUBLE AS o
      FROM proposals a JOIN proposals b ON a.pair_id = b.pair_id AND a.source LIKE 'frontier%' AND b.source NOT LIKE 'frontier%'))
  WHERE u >= 0.12 OR c >= 0.5) WHERE r = 1""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """For each scouted box the candidate that holds it best, if any overlaps enough."""
    p = T.proposals(spark, d)
    scouted = F.col("source").startswith("frontier")
    side = lambda rows, s: rows.select("pair_id", *(F.col(c).alias(f"{s}_{c}") for c in ("proposal_id", "left", "top", "width", "height")))
    rows = side(p.where(scouted), "a").join(side(p.where(~scouted), "b"), "pair_id").withColumn("c", B.containment("a_", "b_")).withColumn("u", B.iou("a_", "b_")).where("u >= 0.12 OR c >= 0.5")
    best = F.max_by("b_proposal_id", F.struct("c", "u", -F.col("b_proposal_id")))
    return rows.groupBy("pair_id", F.col("a_proposal_id").alias("a_id")).agg(best.alias("b_id"))


def _cells(rows: DataFrame) -> DataFrame:
    """A row for each grid cell that a box touches: turns an overlap join into an equi-join."""
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / CELL), F.floor((F.col(at) + F.col(size) - 1) / CELL)))
    return rows.withColumn("cx", span("left", "width")).withColumn("cy", span("top", "height"))


_ROI = "(SELECT * FROM (VALUES (0, 100, 100, 300, 200), (1, 480, 420, 60, 50)) t(roi, l, t, w, h))"


def _roi(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("roi", "l", "t", "w", "h"), r, strict=True))) for r in ((0, 100, 100, 300, 200), (1, 480, 420, 60, 50))))))


def _touches() -> F.Column:
    return (F.col("left") < F.col("l") + F.col("w")) & (F.col("l") < F.col("left") + F.col("width")) & (F.col("top") < F.col("t") + F.col("h")) & (F.col("t") < F.col("top") + F.col("height"))


_TOUCH = """p."left" < r.l + r.w AND r.l < p."left" + p.width AND p.top < r.t + r.h AND r.t < p.top + p.height"""


@query("roi_semi", WITH + f"SELECT pair_id, proposal_id FROM proposals p WHERE EXISTS (SELECT 1 FROM {_ROI} r WHERE {_TOUCH})")
def roi_semi(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that overlap one of the two regions asked for (a list of fixed size, so broadcast)."""
    return T.proposals(spark, d).join(F.broadcast(_roi(spark)), _touches(), "left_semi").select("pair_id", "proposal_id")


@query("roi_anti", WITH + f"SELECT pair_id, proposal_id FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM {_ROI} r WHERE {_TOUCH})")
def roi_anti(spark: SparkSession, d: str) -> DataFrame:
    return T.proposals(spark, d).join(F.broadcast(_roi(spark)), _touches(), "left_anti").select("pair_id", "proposal_id")


@query("cell_overlap_join", WITH + f"""
SELECT DISTINCT a.pair_id, a.proposal_id AS a_id, b.proposal_id AS b_id FROM proposals a JOIN proposals b ON a.pair_id = b.pair_id + 1 AND {_OVER} > 0""")
def cell_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps between neighbouring pairs through grid cells, so the join key is as fine as the boxes."""
    keep = ["pair_id", "proposal_id", "left", "top", "width", "height"]
    rows = T.proposals(spark, d).select(*keep)
    a = _cells(rows).select(*(F.col(c).alias(f"a_{c}") for c in keep), "cx", "cy")
    b = _cells(rows).select(*(F.col(c).alias(f"b_{c}") for c in keep), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    met = a.join(b, (F.col("a_pair_id") == F.col("b_pair_id") + 1) & (F.col("cx") == F.col("bx")) & (F.col("cy") == F.col("by"))).where(B.overlap("a_", "b_") > 0)
    first = lambda low: F.floor(F.greatest(f"a_{low}", f"b_{low}") / CELL)  # noqa: E731  boxes count in the first cell that both reach into
    met = met.where((F.col("cx") == first("left")) & (F.col("cy") == first("top")))
    return met.select(F.col("a_pair_id").alias("pair_id"), F.col("a_proposal_id").alias("a_id"), F.col("b_proposal_id").alias("b_id"))


@query("homography_project", WITH + """
SELECT parcel_id, round((1.1 * x + 0.05 * y + 20) / w, 6) AS px, round((-0.02 * x + 0.97 * y + 32) / w, 6) AS py FROM (
  SELECT parcel_id, x, y, 0.00001::DOUBLE * x + 0.00002::DOUBLE * y + 1 AS w FROM (SELECT parcel_id, (parcel_key % 900)::DOUBLE AS x, gps_lat_e4::DOUBLE AS y FROM parcels))""")
def homography_project(spark: SparkSession, d: str) -> DataFrame:
    h = [F.lit(v) for v in (1.1, 0.05, 20.0, -0.02, 0.97, 32.0, 0.00001, 0.00002, 1.0)]
    x, y = B.project(h, (F.col("parcel_key") % 900).cast("double"), F.col("gps_lat_e4").cast("double"))
    return T.parcels(spark, d).select("parcel_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("tile_layout", """
WITH f AS (SELECT o_orderkey AS pair_id, 900 + o_orderkey % 1500 AS w, 700 + o_orderkey % 900 AS h FROM orders),
x AS (SELECT DISTINCT pair_id, least(k * 614, greatest(0, w - 768)) AS tx FROM (SELECT *, unnest(range(0, CASE WHEN w > 768 THEN (w - 768 + 613) // 614 ELSE 0 END + 1)) AS k FROM f)),
y AS (SELECT DISTINCT pair_id, least(k * 614, greatest(0, h - 768)) AS ty FROM (SELECT *, unnest(range(0, CASE WHEN h > 768 THEN (h - 768 + 613) // 614 ELSE 0 END + 1)) AS k FROM f))
SELECT pair_id, tx, ty FROM x JOIN y USING (pair_id)""")
def tile_layout(spark: SparkSession, d: str, size: int = 768, overlap: float = 0.2) -> DataFrame:
    """Tiles of a stride of round(size * (1 - overlap)); the last lies flush with the frame's edge, none twice."""
    stride = int(size * (1 - overlap) + 0.5)
    k = F.col("o_orderkey")
    frames = T.read(spark, d, "orders").select(k.alias("pair_id"), (900 + k % 1500).alias("w"), (700 + k % 900).alias("h"))

    def axis(n: str) -> F.Column:
        last = F.greatest(F.lit(0).cast("long"), F.col(n) - size)
        steps = F.when(last > 0, F.ceil(last / stride)).otherwise(0).cast("long")
        return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda i: F.least(i * stride, last)))

    return frames.withColumn("tx", F.explode(axis("w"))).withColumn("ty", F.explode(axis("h"))).select("pair_id", "tx", "ty")


@query("rasterize_polygon", WITH + """,
s AS (SELECT parcel_key, 3 + parcel_key % 4 AS r, 10 + parcel_key % 5 AS cx FROM parcels),
g AS (SELECT s.*, x, y FROM s, (SELECT unnest(range(0, 24)) AS x), (SELECT unnest(range(0, 24)) AS y))
SELECT parcel_key, count(*) AS pixels, min(x) AS x0, max(y) AS y1 FROM g WHERE abs(x + 0.25 - cx) + abs(y + 0.5 - 10) < r GROUP BY 1""")
def rasterize_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose centres lie in a diamond, by the even-odd rule, row by row."""
    k = F.col("parcel_key")
    rows = T.parcels(spark, d).select(k, (3 + k % 4).cast("int").alias("r"), (10 + k % 5).cast("int").alias("cx"))
    ring = F.array(*(F.struct((F.col("cx") + a * F.col("r") + 0.25).alias("x"), (10 + b * F.col("r")).cast("double").alias("y")) for a, b in ((-1, 0), (0, -1), (1, 0), (0, 1))))
    lines = of_rings(rows.select(k, ring.alias("ring")), ["parcel_key"], 24, 24)
    return lines.groupBy("parcel_key").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.min("x0").alias("x0"), F.max("y").alias("y1"))


#: Corners of a five-pointed star drawn in one stroke, which crosses itself, and of a concave arrow, in units of a radius.
STAR, ARROW = ((0.0, -1.0), (0.59, 0.81), (-0.95, -0.31), (0.95, -0.31), (-0.59, 0.81)), ((-1.0, -0.9), (0.9, -1.0), (0.1, 0.2), (1.0, 0.9), (-0.8, 1.0))
_CORNERS = lambda shape: "[" + ", ".join(f"{{'x': {x}::DOUBLE * r + cx, 'y': {y}::DOUBLE * r + 13.3::DOUBLE}}" for x, y in shape) + "]"


@query("polygon_runs", WITH + f""",
s AS (SELECT parcel_key, (5 + parcel_key % 9)::DOUBLE AS r, 14 + (parcel_key % 7) * 0.37::DOUBLE AS cx FROM parcels),
g AS (SELECT parcel_key, CASE WHEN parcel_key % 2 = 0 THEN {_CORNERS(STAR)} ELSE {_CORNERS(ARROW)} END AS ring FROM s),
e AS (SELECT parcel_key, ring[i] AS p, ring[i % 5 + 1] AS q FROM (SELECT *, unnest(range(1, 6)) AS i FROM g)),
c AS (SELECT parcel_key, y, x, count(*) % 2 = 1 AS inside FROM e JOIN (SELECT unnest(range(28)) AS y) ON (p.y > y + 0.5) <> (q.y > y + 0.5) JOIN (SELECT unnest(range(28)) AS x) ON x + 0.5 < (q.x - p.x) * (y + 0.5 - p.y) / (q.y - p.y) + p.x GROUP BY 1, 2, 3),
i AS (SELECT *, lag(x) OVER (PARTITION BY parcel_key, y ORDER BY x) AS before FROM c WHERE inside)
SELECT parcel_key, y, count(*) AS pixels, count(*) FILTER (before IS NULL OR before < x - 1) AS runs, min(x) AS first, max(x) AS last FROM i GROUP BY 1, 2""")
def polygon_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of concave and self-crossing polygons by the even-odd rule, from crossings of edges and rows."""
    k = F.col("parcel_key")
    r, cx = (5 + k % 9).cast("double"), 14 + (k % 7) * F.lit(0.37)
    ring = lambda shape: F.array(*(F.struct((F.lit(x) * r + cx).alias("x"), (F.lit(y) * r + F.lit(13.3)).alias("y")) for x, y in shape))
    rows = T.gathered(T.parcels(spark, d).select(k), "parcel_key").select(k, F.when(k % 2 == 0, ring(STAR)).otherwise(ring(ARROW)).alias("ring"))
    lines = of_rings(rows, ["parcel_key"], 28, 28)  # runs of a row are disjoint and may touch
    begins = F.coalesce(F.lag("x1").over(Window.partitionBy("parcel_key", "y").orderBy("x0")) != F.col("x0"), F.lit(True))
    lines = lines.withColumn("new", begins)
    return lines.groupBy("parcel_key", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.count_if("new").alias("runs"), F.min("x0").alias("first"), (F.max("x1") - 1).alias("last"))


@query("ranked_limit", WITH + """
SELECT pair_id, proposal_id, r AS rank, r <= 3 AS included FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY confidence_e3 DESC, proposal_id) AS r FROM proposals)""")
def ranked_limit(spark: SparkSession, d: str, limit: int = 3) -> DataFrame:
    """Rank by confidence, one audit row for each; included up to the limit."""
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("confidence_e3"), "proposal_id"))
    return T.proposals(spark, d).select("pair_id", "proposal_id", rank.alias("rank")).withColumn("included", F.col("rank") <= limit)
