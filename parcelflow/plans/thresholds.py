"""Thresholds of frames and of their cells from planes made by stencils: exclusions, tail, guard and clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import levels as L
from parcelflow.operators import stencils as S
from parcelflow.operators.settings import Settings
from parcelflow.plans.masks import _SCENE, KEY, scene_frames, scenes
from parcelflow.plans.raster import WITH, similarity
from parcelflow.plans.registry import query
from parcelflow.sources.scratch import Scratch

SET = Settings()


def planes_of(cut: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Pixels (keys, y, x) of tiles of grey planes a and b with margins of 2: a, b, ga and gb (gradients), color, structure and score.

    color: symmetric residual within one pixel, lowered where its 3 x 3 neighbours don't agree; structure: the
    residual of structural similarity; score: both fused, weak ones damped.
    """
    h, w = F.col("h"), F.col("w")
    one = {c: S.core(F.col(c), 1, h + 2, w + 2) for c in "ab"}
    product = lambda p, q: F.zip_with(p, q, lambda u, v: F.zip_with(u, v, lambda x, y: x * y))
    cut = cut.withColumns({"aa": product("a", "a"), "bb": product("b", "b"), "ab": product("a", "b"), "a1": one["a"], "b1": one["b"]})
    two = F.zip_with(S.nearest(F.col("a"), F.col("b"), h + 2, w + 2), S.nearest(F.col("b"), F.col("a"), h + 2, w + 2), lambda u, v: F.zip_with(u, v, lambda x, y: F.floor(0.6 * F.greatest(x, y) + 0.2 * (x + y) + 0.5)))
    cut = cut.withColumn("s", two)
    parts = {
        "a": S.core(F.col("a"), 2, h, w), "b": S.core(F.col("b"), 2, h, w), "ga": S.sobel(F.col("a1"), h, w), "gb": S.sobel(F.col("b1"), h, w), "own": S.core(F.col("s"), 1, h, w),
        "around": S.moving(F.col("s"), 1, h, w, S.total), "near": S.moving(F.col("s"), 1, h, w, S.present, S.total), "n": S.moving(F.col("a"), 2, h, w, S.present, S.total),
        **{f"s{c}": S.moving(F.col(c), 2, h, w, S.total) for c in ("a", "b", "aa", "bb", "ab")},
    }
    rows = S.pixels(cut.select(*keys, "ty", "tx", *(v.alias(n) for n, v in parts.items())), keys, list(parts), side).where("a is not null")  # rows of a frame may end early
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("n", "sa", "sb", "saa", "sbb", "sab")})
    mean = F.floor(F.col("around") / F.col("near") + 0.5)
    rows = rows.withColumn("color", F.floor(F.greatest(0.82 * F.col("own"), 0.68 * F.col("own") + 0.32 * mean) + 0.5))
    rows = rows.withColumn("structure", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (1 - F.round(similarity(), 9)) / 1.2 * 255)) + 0.5))
    return rows.select(*keys, "y", "x", "a", "b", "ga", "gb", "color", "structure", fused(F.col("color"), F.col("structure")).alias("score"))


def fused(color: Column, structure: Column) -> Column:
    """A byte from colour and structure by their weights; weak pairs are damped."""
    c, s = F.least(F.lit(1.0), color / 64.0), structure / 255.0
    p = c * SET.color + s * SET.structure
    return F.floor(255 * F.when((c < 0.18) & (s < 0.22), p * 0.18).otherwise(p) + 0.5)


def why_excluded() -> Column:
    """The first reason why a pixel doesn't count as background, else stable; what the frame hides (here: its first row) comes first."""
    c = F.col
    return (
        F.when(c("y") == 0, "ui_or_viewport").when(c("a") < 40, "invalid_overlap").when((c("ga") > SET.max_gradient) | (c("gb") > SET.max_gradient), "strong_gradient")
        .when(c("structure") > SET.max_structure, "structural_change").when(c("color") > SET.max_color, "color_change").otherwise("stable")
    )


def scene_pixels(spark: SparkSession, d: str, side: int = S.SIDE) -> DataFrame:
    rows = scenes(spark, d)
    cut = S.with_halo(S.tiles(rows, KEY, ["a", "b"], side), KEY, ["a", "b"], 2)
    return planes_of(cut, KEY, side).withColumn("why", why_excluded())


def cell_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each scene's 4 x 4 cells, valid and candidates."""
    rows = scene_pixels(spark, d).join(scene_frames(scenes(spark, d)), KEY)
    place = lambda c, size: F.least(F.lit(SET.cells - 1), F.floor(((F.col(c) + 1) * SET.cells - 1) / F.col(size)))
    rows = rows.withColumn("row", place("y", "height")).withColumn("col", place("x", "width"))
    seen = ~F.col("why").isin("ui_or_viewport", "invalid_overlap")
    return L.counters(rows, [*KEY, "row", "col"], "score", valid=seen, candidates=F.col("why") == "stable")


_PLANES = WITH + _SCENE + f""",
g2 AS (SELECT p.scene_id, p.y, p.x, p.a, p.b, min(abs(p.a - n.b)) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1) AS ab, min(abs(p.b - n.a)) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1) AS ba,
  count(*) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1) AS near,
  sum(n.a * (n.x - p.x) * (2 - abs(n.y - p.y))) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)::DOUBLE AS ax, sum(n.a * (n.y - p.y) * (2 - abs(n.x - p.x))) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)::DOUBLE AS ay,
  sum(n.b * (n.x - p.x) * (2 - abs(n.y - p.y))) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)::DOUBLE AS bgx, sum(n.b * (n.y - p.y) * (2 - abs(n.x - p.x))) FILTER (abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)::DOUBLE AS bgy,
  count(*)::DOUBLE AS n, sum(n.a)::DOUBLE AS sa, sum(n.b)::DOUBLE AS sb, sum(n.a * n.a)::DOUBLE AS saa, sum(n.b * n.b)::DOUBLE AS sbb, sum(n.a * n.b)::DOUBLE AS sab
  FROM sp p JOIN sp n ON n.scene_id = p.scene_id AND abs(n.y - p.y) <= 2 AND abs(n.x - p.x) <= 2 GROUP BY ALL),
s1 AS (SELECT *, floor(0.6::DOUBLE * greatest(ab, ba) + 0.2::DOUBLE * (ab + ba) + 0.5) AS s, CASE WHEN near = 9 THEN least(255, floor(sqrt(ax * ax + ay * ay) / 4 + 0.5)) ELSE 0 END AS ga, CASE WHEN near = 9 THEN least(255, floor(sqrt(bgx * bgx + bgy * bgy) / 4 + 0.5)) ELSE 0 END AS gb,
  (2 * sa * sb / n / n + 6.5025) * (2 * (sab / n - sa * sb / n / n) + 58.5225) / ((sa * sa / n / n + sb * sb / n / n + 6.5025) * (saa / n - sa * sa / n / n + sbb / n - sb * sb / n / n + 58.5225)) AS sim FROM g2),
m1 AS (SELECT p.scene_id, p.y, p.x, floor(sum(n.s) / count(*) + 0.5) AS mean FROM s1 p JOIN s1 n ON n.scene_id = p.scene_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY ALL),
c1 AS (SELECT s1.*, floor(greatest(0.82::DOUBLE * s, 0.68::DOUBLE * s + 0.32::DOUBLE * mean) + 0.5) AS color, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (1 - round(sim, 9)) / 1.2::DOUBLE * 255)) + 0.5) AS structure FROM s1 JOIN m1 USING (scene_id, y, x)),
u1 AS (SELECT *, least(1.0::DOUBLE, color / 64.0::DOUBLE) AS uc, structure / 255.0::DOUBLE AS us FROM c1),
e1 AS (SELECT *, floor(255 * CASE WHEN uc < 0.18 AND us < 0.22 THEN (uc * 0.45::DOUBLE + us * 0.4::DOUBLE) * 0.18::DOUBLE ELSE uc * 0.45::DOUBLE + us * 0.4::DOUBLE END + 0.5)::BIGINT AS score,
  CASE WHEN y = 0 THEN 'ui_or_viewport' WHEN a < 40 THEN 'invalid_overlap' WHEN ga > {SET.max_gradient} OR gb > {SET.max_gradient} THEN 'strong_gradient' WHEN structure > {SET.max_structure} THEN 'structural_change' WHEN color > {SET.max_color} THEN 'color_change' ELSE 'stable' END AS why FROM u1)"""

_KEEP = "median(score) FILTER ({c})::DOUBLE"


def _stats(name: str, rows: str, key: str, fall: str) -> str:
    """Common table expressions: {name} has, by key, the used values' median and mad, the guard and the counts; fall: what is used without stable ones."""
    return f"""
{name}_1 AS (SELECT {key}, coalesce(median(score) FILTER (cand), 0)::DOUBLE AS m FROM {rows} GROUP BY {key}),
{name}_2 AS (SELECT {key}, any_value(m) AS m, coalesce(median(abs(score - m)) FILTER (cand), 0)::DOUBLE AS d FROM {rows} JOIN {name}_1 USING ({key}) GROUP BY {key}),
{name}_3 AS (SELECT r.*, cand AND score <= m + {SET.tail_mads}::DOUBLE * greatest(2, d) AS stab FROM {rows} r JOIN {name}_2 USING ({key})),
{name}_4 AS (SELECT *, CASE WHEN bool_or(stab) OVER w THEN stab WHEN bool_or({fall}) OVER w THEN {fall} ELSE ok END AS used FROM {name}_3 WINDOW w AS (PARTITION BY {key})),
{name}_5 AS (SELECT {key}, coalesce(median(score) FILTER (used), 0)::DOUBLE AS median, count(*) FILTER (ok) AS valid_pixels, count(*) FILTER (stab) AS stable_pixels, count(*) FILTER (cand AND NOT stab) AS tail_pixels,
  coalesce((list(score ORDER BY score) FILTER (ok))[(floor((count(*) FILTER (ok) - 1) * {1 - SET.seed_share}::DOUBLE + 0.5) + 1)::INT], 0)::DOUBLE AS guard FROM {name}_4 GROUP BY {key}),
{name} AS (SELECT {key}, any_value(median) AS median, coalesce(median(abs(score - median)) FILTER (used), 0)::DOUBLE AS mad, any_value(guard) AS guard, any_value(valid_pixels) AS valid_pixels, any_value(stable_pixels) AS stable_pixels, any_value(tail_pixels) AS tail_pixels FROM {name}_4 JOIN {name}_5 USING ({key}) GROUP BY {key})"""


_RAW_LOW = f"greatest(high * {SET.low_share}::DOUBLE, median + {SET.low_mads} * greatest(2, mad))"
_FRAME = _PLANES + ",\nr1 AS (SELECT *, why NOT IN ('ui_or_viewport', 'invalid_overlap') AS ok, why = 'stable' AS cand FROM e1)," + _stats("f", "r1", "scene_id", "cand") + f""",
fh AS (SELECT *, least({SET.high_ceiling}, greatest({SET.high_floor}, median + {SET.high_mads} * greatest(2, mad), guard))::DOUBLE AS high FROM f),
fl AS (SELECT *, least(greatest({SET.low_floor}, high - 1), greatest({SET.low_floor}, {_RAW_LOW}))::DOUBLE AS low FROM fh)"""


@query("frame_thresholds", _FRAME + f"""
SELECT scene_id, round(median, 6) AS median, round(mad, 6) AS mad, guard, round(low, 6) AS low, round(high, 6) AS high, valid_pixels, stable_pixels, tail_pixels, stable_pixels >= greatest({SET.stable_pixels}, floor(valid_pixels * {SET.stable_share}::DOUBLE + 0.5)) AS enough FROM fl""")
def frame_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Low and high threshold of each scene from its background, with exclusions, the tail left out and the guard by the share of seeds."""
    rows = L.frame_thresholds(Scratch(spark, "thresholds"), cell_counters(spark, d), KEY)
    return rows.withColumns({c: F.round(c, 6) for c in ("median", "mad", "low", "high")})


@query("cell_thresholds", _FRAME + f""",
z AS (SELECT scene_id, max(x) + 1 AS w, max(y) + 1 AS h FROM sp GROUP BY 1),
r2 AS (SELECT r1.*, least(3, ((y + 1) * 4 - 1) // h)::BIGINT AS row, least(3, ((x + 1) * 4 - 1) // w)::BIGINT AS col FROM r1 JOIN z USING (scene_id)),""" + _stats("k", "r2", "scene_id, row, col", "FALSE") + f""",
kj AS (SELECT k.*, fl.low AS flow, fl.high AS fhigh FROM k JOIN fl USING (scene_id)),
kh AS (SELECT *, greatest(greatest({SET.high_floor}, fhigh), least(greatest(median + {SET.high_mads} * greatest(2, mad), guard, {SET.high_floor}), greatest(greatest({SET.high_floor}, fhigh), least({SET.high_ceiling}, fhigh * {SET.local_high}::DOUBLE))))::DOUBLE AS high FROM kj),
kl AS (SELECT *, greatest({SET.low_floor}, flow * {SET.local_low}::DOUBLE) AS least_low FROM kh)
SELECT scene_id, row, col, round(high, 6) AS high, round(least(greatest(least_low, high - 1), greatest(least_low, {_RAW_LOW})), 6) AS low, round(median, 6) AS median, round(mad, 6) AS mad FROM kl""")
def cell_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of each cell of a scene, clamped to the scene's own."""
    scratch = Scratch(spark, "thresholds")
    cells = scratch.put(cell_counters(spark, d), "cells")
    rows = L.cell_thresholds(scratch, cells, KEY, ["row", "col"], L.frame_thresholds(scratch, cells, KEY))
    return rows.select("scene_id", "row", "col", *(F.round(c, 6).alias(c) for c in ("high", "low", "median", "mad")))


@query("background_exclusions", _PLANES + " SELECT scene_id, why AS reason, count(*) AS n FROM e1 GROUP BY 1, 2")
def background_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each scene by the first reason that keeps them out of the background."""
    return scene_pixels(spark, d).groupBy("scene_id", F.col("why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("evidence_planes", _PLANES + " SELECT scene_id, y, x, ga::BIGINT AS ga, gb::BIGINT AS gb, color::BIGINT AS color, structure::BIGINT AS structure, score FROM e1")
def evidence_planes(spark: SparkSession, d: str) -> DataFrame:
    """Gradients, consistent colour residual, structural residual and their score, by stencils on tiles of scenes."""
    return scene_pixels(spark, d).select("scene_id", "y", "x", "ga", "gb", "color", "structure", "score")
