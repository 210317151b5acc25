"""Map algebra on pairs of planes: stencils on tiles, zonal statistics, components, thresholds.

A pair of embeddings gives a pair of square planes. Stencils run on tiles with halos and
components on runs (operators/stencils.py and runs.py), so frames may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.operators import runs as R
from parcelflow.operators import stencils as S
from parcelflow.plans.registry import query
from parcelflow.sources import tables as T
from parcelflow.sources.scratch import Scratch

_PX = """
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
q AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, greatest(0, least(255, floor(128 + 240 * v::DOUBLE)))::BIGINT AS p FROM e),
px AS (SELECT a.pair_id, a.y, a.x, a.p AS a, b.p AS b, abs(a.p - b.p) AS d FROM q a JOIN q b USING (pair_id, y, x) WHERE a.side = 0 AND b.side = 1)"""
WITH = "WITH RECURSIVE" + _PX


def frames(spark: SparkSession, d: str) -> DataFrame:
    """pair_id and the values a (before), b (after), d (absolute difference) of all its pixels as arrays: a row for a pair, so no task holds a row for a pixel.

    Equal ids, which the table doesn't hold, pool their pixels as the SQL does.
    """
    rows = _met(spark, d).select("pair_id", F.col("pa").alias("a"), F.col("pb").alias("b"), F.zip_with("pa", "pb", lambda u, v: F.abs(u - v)).alias("d"))
    return rows.groupBy("pair_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in "abd")).where(F.size("d") > 0)


def _met(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, pa, pb: planes are joined before they are taken apart, as far as both go; larger tables make more partitions."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 240 * v.cast("double")))).cast("long")
    e = T.gathered(T.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "embedding"), "pair_id")
    e = e.where("embedding is not null").select("pair_id", "side", F.transform("embedding", level).alias("p"))
    both = e.where("side = 0").select("pair_id", F.col("p").alias("pa")).join(e.where("side = 1").select("pair_id", F.col("p").alias("pb")), "pair_id")
    n = F.least(F.size("pa"), F.size("pb"))
    return both.select("pair_id", F.slice("pa", F.lit(1), n).alias("pa"), F.slice("pb", F.lit(1), n).alias("pb"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, y, x, a (before), b (after), d (absolute difference)."""
    rows = _met(spark, d).select("pair_id", F.posexplode(F.arrays_zip("pa", "pb")).alias("i", "z"))
    i = F.col("i")
    return rows.select("pair_id", F.floor(i / 8).alias("y"), (i % 8).cast("long").alias("x"), F.col("z.pa").alias("a"), F.col("z.pb").alias("b"), F.abs(F.col("z.pa") - F.col("z.pb")).alias("d"))


KEY = ["pair_id"]


def tiled(spark: SparkSession, d: str, r: int, *planes_: str) -> DataFrame:
    """Tiles of the named planes (a, b, d) with margins of r pixels."""
    names = list(planes_)
    return S.with_halo(S.tiles(planes(spark, d), KEY, names), KEY, names, r)


def dots(cut: DataFrame, **values: Column) -> DataFrame:
    """A row for each pixel of tiles (pair_id, y, x, values), as results ask for it."""
    return S.pixels(cut.select("pair_id", "ty", "tx", *(v.alias(n) for n, v in values.items())), KEY, list(values))


def moving(c: str, r: int, fold, again=None) -> Column:
    return S.moving(F.col(c), r, F.col("h"), F.col("w"), fold, again)


def _square(r: int) -> str:
    return f"FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - {r} AND p.y + {r} AND n.x BETWEEN p.x - {r} AND p.x + {r} GROUP BY p.pair_id, p.y, p.x"


@query("box_mean", WITH + f" SELECT p.pair_id, p.y, p.x, floor(sum(n.d)::DOUBLE / count(*) + 0.5)::BIGINT AS mean {_square(2)}")
def box_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = dots(tiled(spark, d, 2, "d"), s=moving("d", 2, S.total), n=moving("d", 2, S.present, S.total))
    return rows.select("pair_id", "y", "x", F.floor(F.col("s") / F.col("n") + 0.5).alias("mean"))


@query("min_filter", WITH + f" SELECT p.pair_id, p.y, p.x, min(n.d) AS low, max(n.d) AS high {_square(1)}")
def min_filter(spark: SparkSession, d: str) -> DataFrame:
    return dots(tiled(spark, d, 1, "d"), low=moving("d", 1, F.array_min), high=moving("d", 1, F.array_max))


@query("ssim", WITH + f"""
SELECT pair_id, y, x, round((2 * sa * sb / n / n + 6.5025) * (2 * (sab / n - sa * sb / n / n) + 58.5225) / ((sa * sa / n / n + sb * sb / n / n + 6.5025) * (saa / n - sa * sa / n / n + sbb / n - sb * sb / n / n + 58.5225)), 5) AS ssim FROM (
  SELECT p.pair_id, p.y, p.x, count(*)::DOUBLE AS n, sum(n.a)::DOUBLE AS sa, sum(n.b)::DOUBLE AS sb, sum(n.a * n.a)::DOUBLE AS saa, sum(n.b * n.b)::DOUBLE AS sbb, sum(n.a * n.b)::DOUBLE AS sab {_square(2)})""")
def ssim(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity from five separable window sums, clipped at the frame's edge."""
    cut = tiled(spark, d, 2, "a", "b")
    product = lambda p, q: F.zip_with(p, q, lambda u, v: F.zip_with(u, v, lambda x, y: x * y))
    cut = cut.withColumns({"aa": product("a", "a"), "bb": product("b", "b"), "ab": product("a", "b")})
    rows = dots(cut, n=moving("a", 2, S.present, S.total), **{f"s{c}": moving(c, 2, S.total) for c in ("a", "b", "aa", "bb", "ab")})
    return rows.withColumns({c: F.col(c).cast("double") for c in ("n", "sa", "sb", "saa", "sbb", "sab")}).select("pair_id", "y", "x", F.round(similarity(), 5).alias("ssim"))


def similarity() -> Column:
    """SSIM of a window from its sums n, sa, sb, saa, sbb, sab."""
    return F.expr("(2 * sa * sb / n / n + 6.5025D) * (2 * (sab / n - sa * sb / n / n) + 58.5225D) / ((sa * sa / n / n + sb * sb / n / n + 6.5025D) * (saa / n - sa * sa / n / n + sbb / n - sb * sb / n / n + 58.5225D))")


@query("masked_ssim", WITH + f"""
SELECT pair_id, y, x, round((2 * sa * sb / n / n + 6.5025) * (2 * (sab / n - sa * sb / n / n) + 58.5225) / ((sa * sa / n / n + sb * sb / n / n + 6.5025) * (saa / n - sa * sa / n / n + sbb / n - sb * sb / n / n + 58.5225)), 5) AS ssim FROM (
  SELECT p.pair_id, p.y, p.x, count(*)::DOUBLE AS n, sum(n.a)::DOUBLE AS sa, sum(n.b)::DOUBLE AS sb, sum(n.a * n.a)::DOUBLE AS saa, sum(n.b * n.b)::DOUBLE AS sbb, sum(n.a * n.b)::DOUBLE AS sab
  FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - 2 AND p.y + 2 AND n.x BETWEEN p.x - 2 AND p.x + 2 AND n.a > 96 WHERE p.a > 96 GROUP BY ALL)""")
def masked_ssim(spark: SparkSession, d: str, valid: int = 96) -> DataFrame:
    """Structural similarity over valid pixels only (here: bright ones of the earlier plane)."""
    keep = lambda p: F.zip_with("a", p, lambda u, v: F.zip_with(u, v, lambda x, y: F.when(x > valid, y)))
    cut = tiled(spark, d, 2, "a", "b")
    cut = cut.withColumns({"va": keep("a"), "vb": keep("b")})
    product = lambda p, q: F.zip_with(p, q, lambda u, v: F.zip_with(u, v, lambda x, y: x * y))
    cut = cut.withColumns({"vaa": product("va", "va"), "vbb": product("vb", "vb"), "vab": product("va", "vb")})
    own = S.core(F.col("va"), 2, F.col("h"), F.col("w"))
    rows = dots(cut, own=own, n=moving("va", 2, S.present, S.total), **{f"s{c}": moving(f"v{c}", 2, S.total) for c in ("a", "b", "aa", "bb", "ab")})
    rows = rows.where("own is not null").withColumns({c: F.col(c).cast("double") for c in ("n", "sa", "sb", "saa", "sbb", "sab")})
    return rows.select("pair_id", "y", "x", F.round(similarity(), 5).alias("ssim"))


_GRAD = """
g AS (SELECT *, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 0 ELSE least(255, floor(sqrt(gx * gx + gy * gy) / 4 + 0.5))::BIGINT END AS grad FROM (
  SELECT p.pair_id, p.y, p.x, p.d, sum(n.a * (n.x - p.x) * (2 - abs(n.y - p.y)))::DOUBLE AS gx, sum(n.a * (n.y - p.y) * (2 - abs(n.x - p.x)))::DOUBLE AS gy
  FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - 1 AND p.y + 1 AND n.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL))"""


def with_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Pixels (pair_id, y, x, a, b, d) with grad, the Sobel magnitude of the earlier plane; 0 at the border."""
    inner = lambda c: S.core(F.col(c), 1, F.col("h"), F.col("w"))
    return dots(tiled(spark, d, 1, "a", "b", "d"), a=inner("a"), b=inner("b"), d=inner("d"), grad=S.sobel(F.col("a"), F.col("h"), F.col("w")))


@query("gray_gradient", WITH + "," + _GRAD + " SELECT pair_id, y, x, grad FROM g")
def gray_gradient(spark: SparkSession, d: str) -> DataFrame:
    return dots(tiled(spark, d, 1, "a"), grad=S.sobel(F.col("a"), F.col("h"), F.col("w")))


@query("color_residual", WITH + """,
m AS (SELECT p.pair_id, p.y, p.x, min(abs(p.a - n.b)) AS ab, min(abs(p.b - n.a)) AS ba FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - 1 AND p.y + 1 AND n.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL)
SELECT pair_id, y, x, floor(0.6::DOUBLE * greatest(ab, ba) + 0.4::DOUBLE * ((ab + ba) / 2.0::DOUBLE) + 0.5)::BIGINT AS residual FROM m""")
def color_residual(spark: SparkSession, d: str) -> DataFrame:
    """Least difference within one pixel, both ways."""
    near = lambda p, q: S.nearest(F.col(p), F.col(q), F.col("h"), F.col("w"))
    rows = dots(tiled(spark, d, 1, "a", "b"), ab=near("a", "b"), ba=near("b", "a"))
    return rows.select("pair_id", "y", "x", F.floor(0.6 * F.greatest("ab", "ba") + 0.4 * ((F.col("ab") + F.col("ba")) / 2) + 0.5).alias("residual"))


@query("evidence_score", WITH + "," + _GRAD + """,
u AS (SELECT pair_id, y, x, least(1.0::DOUBLE, d / 64.0::DOUBLE) AS c, least(255, d * 2) / 255.0::DOUBLE AS s, least(1.0::DOUBLE, grad / 96.0::DOUBLE) AS t, (d // 2) / 255.0::DOUBLE AS m FROM g),
w AS (SELECT *, 0.45 * c + 0.40 * s + 0.15 * t AS p FROM u),
v AS (SELECT *, CASE WHEN c < 0.18 AND s < 0.22 THEN p * 0.18 WHEN t > 0.55 AND c < 0.25 AND s < 0.3 THEN p * 0.45 ELSE p END AS r FROM w)
SELECT pair_id, y, x, floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN m >= 0.28 AND s >= 0.18 THEN greatest(r, m * (0.42 + 0.28) + 0.12 * s + 0.04 * t) ELSE r END)) + 0.5)::BIGINT AS score FROM v""")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Colour, structure and edges fused; weak pairs damped, removed structures raised."""
    rows = with_gradient(spark, d).select(
        "pair_id", "y", "x", F.least(F.lit(1.0), F.col("d") / 64.0).alias("c"), (F.least(F.lit(255), F.col("d") * 2) / 255.0).alias("s"), F.least(F.lit(1.0), F.col("grad") / 96.0).alias("t"), (F.floor(F.col("d") / 2) / 255.0).alias("m")
    )
    c, s, t, m = (F.col(k) for k in "cstm")
    p = 0.45 * c + 0.40 * s + 0.15 * t
    damped = F.when((c < 0.18) & (s < 0.22), p * 0.18).when((t > 0.55) & (c < 0.25) & (s < 0.3), p * 0.45).otherwise(p)
    raised = F.when((m >= 0.28) & (s >= 0.18), F.greatest(damped, m * (0.42 + 0.28) + 0.12 * s + 0.04 * t)).otherwise(damped)
    return rows.select("pair_id", "y", "x", F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), raised)) + 0.5).alias("score"))


RANKS = ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.988, "p988"), (0.99, "p99"))


def middle(c: str) -> Column:
    """The median of a sorted array."""
    at = lambda i: F.get(c, F.floor(i).cast("int"))
    return (at((F.size(c) - 1) / 2) + at(F.size(c) / 2)) / 2


def spread(rows: DataFrame, c: str) -> DataFrame:
    """rows with the median and the MAD of a sorted array."""
    rows = rows.withColumn("median", middle(c))
    return rows.withColumn("_v", F.sort_array(F.transform(c, lambda v: F.abs(v - F.col("median"))))).withColumn("mad", middle("_v")).drop("_v")


def robust(rows: DataFrame, keys: list[str], c: str = "d") -> DataFrame:
    """n, median, MAD and nearest-rank percentiles of the values in array c of each row: keys name a row."""
    rows = spread(rows.select(*keys, F.sort_array(c).alias("_s")), "_s").withColumn("n", F.size("_s").cast("long"))
    at = lambda p: F.get("_s", F.floor((F.col("n") - 1) * p + 0.5).cast("int"))
    return rows.select(*keys, "n", "median", *(at(p).alias(name) for p, name in RANKS), "mad")


def _stats(key: str, frm: str) -> str:
    return f"""
m AS (SELECT {key}, median(d)::DOUBLE AS med, list_sort(list(d)) AS l, count(*) AS n FROM {frm} GROUP BY {key}),
st AS (SELECT m.{key}, any_value(m.n) AS n, any_value(med) AS median, median(abs(f.d - med))::DOUBLE AS mad,
  {", ".join(f"any_value(l[(floor((m.n - 1) * {p} + 0.5) + 1)::INT]) AS {name}" for p, name in RANKS)}
  FROM m JOIN {frm} f USING ({key}) GROUP BY m.{key})"""


@query("robust_stats", WITH + "," + _stats("pair_id", "px") + " SELECT pair_id, n, median, mad, " + ", ".join(n for _, n in RANKS) + " FROM st")
def robust_stats(spark: SparkSession, d: str) -> DataFrame:
    return robust(frames(spark, d), ["pair_id"]).select("pair_id", "n", "median", "mad", *(n for _, n in RANKS))


_THRESHOLDS = """
th AS (SELECT *, least(220, greatest(24, greatest(median + 6 * greatest(2, mad), p988)))::DOUBLE AS high FROM st),
lo AS (SELECT *, least(greatest(10, high - 1), greatest(10, greatest(0.45::DOUBLE * high, median + 3 * greatest(2, mad))))::DOUBLE AS low FROM th)"""


def thresholds(stats: DataFrame) -> DataFrame:
    """High from median and MAD, guarded by the 98.8th percentile; low a share of it or three MADs."""
    noise = F.greatest(F.lit(2.0), F.col("mad"))
    high = F.least(F.lit(220.0), F.greatest(F.lit(24.0), F.col("median") + 6 * noise, F.col("p988").cast("double")))
    low = F.least(F.greatest(F.lit(10.0), F.col("high") - 1), F.greatest(F.lit(10.0), 0.45 * F.col("high"), F.col("median") + 3 * noise))
    return stats.withColumn("high", high).withColumn("low", low)


@query("noise_thresholds", WITH + "," + _stats("pair_id", "px") + "," + _THRESHOLDS + " SELECT pair_id, round(high, 6) AS high, round(low, 6) AS low FROM lo")
def noise_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return thresholds(robust(frames(spark, d), ["pair_id"])).select("pair_id", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


@query("local_thresholds", WITH + ", cells AS (SELECT (pair_id * 4 + (y // 4) * 2 + x // 4) AS cell, d FROM px)," + _stats("cell", "cells") + "," + _THRESHOLDS + " SELECT cell, floor(high + 0.5)::BIGINT AS high, floor(low + 0.5)::BIGINT AS low FROM lo")
def local_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The same statistics for each quarter of a plane."""
    quarter = lambda i: (F.floor(i / 32) * 2 + F.floor(i % 8 / 4)).cast("long")  # noqa: E731  of pixel i: y is i / 8, x is i % 8
    rows = _met(spark, d).select("pair_id", F.zip_with("pa", "pb", lambda u, v: F.abs(u - v)).alias("d")).where(F.size("d") > 0)
    rows = rows.withColumn("q", F.explode(F.array_distinct(F.transform("d", lambda v, i: quarter(i)))))
    rows = rows.select((F.col("pair_id") * 4 + F.col("q")).alias("cell"), F.filter("d", lambda v, i: quarter(i) == F.col("q")).alias("d"))
    cells = T.gathered(rows, "cell").groupBy("cell").agg(F.flatten(F.collect_list("d")).alias("d"))
    rows = thresholds(robust(cells, ["cell"]))
    return rows.select("cell", F.floor(F.col("high") + 0.5).alias("high"), F.floor(F.col("low") + 0.5).alias("low"))


@query("radiometric_gain", WITH + """,
ma AS (SELECT pair_id, median(a)::DOUBLE AS am, median(b)::DOUBLE AS bm FROM px GROUP BY 1),
md AS (SELECT pair_id, any_value(am) AS am, any_value(bm) AS bm, greatest(1, 1.4826::DOUBLE * median(abs(a - am))) AS ad, greatest(1, 1.4826::DOUBLE * median(abs(b - bm))) AS bd FROM px JOIN ma USING (pair_id) GROUP BY 1)
SELECT pair_id, round(gain, 6) AS gain, round(am - bm * gain, 6) AS bias FROM (SELECT *, least(1.55::DOUBLE, greatest(0.65::DOUBLE, ad / greatest(1, bd))) AS gain FROM md)""")
def radiometric_gain(spark: SparkSession, d: str) -> DataFrame:
    """Scale and offset that bring the later plane's median and MAD to the earlier one's."""
    rows = frames(spark, d).select("pair_id", F.sort_array("a").alias("a"), F.sort_array("b").alias("b"))
    for c in "ab":
        rows = spread(rows, c).withColumnRenamed("median", f"{c}m").withColumn(f"{c}d", F.greatest(F.lit(1.0), 1.4826 * F.col("mad"))).drop("mad")
    gain = F.least(F.lit(1.55), F.greatest(F.lit(0.65), F.col("ad") / F.greatest(F.lit(1.0), F.col("bd"))))
    return rows.withColumn("g", gain).select("pair_id", F.round("g", 6).alias("gain"), F.round(F.col("am") - F.col("bm") * F.col("g"), 6).alias("bias"))


_RUNS = """(SELECT pair_id, x, x - row_number() OVER (PARTITION BY pair_id ORDER BY x) AS k FROM (SELECT pair_id, x, avg((d >= 40)::INT) AS c FROM px GROUP BY 1, 2) WHERE c >= 0.35)"""


@query("border_bands", WITH + f"SELECT pair_id, min(x) AS first, max(x) AS last, count(*) AS n FROM {_RUNS} GROUP BY pair_id, k HAVING count(*) >= 2")
def border_bands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of columns in which many pixels differ: gaps and islands."""
    cover = pixels(spark, d).groupBy("pair_id", "x").agg(F.avg((F.col("d") >= 40).cast("int")).alias("c")).where("c >= 0.35")
    island = F.col("x") - F.row_number().over(Window.partitionBy("pair_id").orderBy("x"))
    return cover.withColumn("k", island).groupBy("pair_id", "k").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("k")


@query("morphology", WITH + """,
m AS (SELECT pair_id, y, x, (d >= 40)::INT AS v FROM px),
er AS (SELECT p.pair_id, p.y, p.x, CASE WHEN count(*) = 9 THEN min(n.v) ELSE 0 END AS v FROM m p JOIN m n ON n.pair_id = p.pair_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY ALL),
op AS (SELECT p.pair_id, p.y, p.x, max(n.v) AS v FROM er p JOIN er n ON n.pair_id = p.pair_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY ALL),
di AS (SELECT p.pair_id, p.y, p.x, max(n.v) AS v FROM m p JOIN m n ON n.pair_id = p.pair_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY ALL),
cl AS (SELECT p.pair_id, p.y, p.x, CASE WHEN count(*) = 9 THEN min(n.v) ELSE 0 END AS v FROM di p JOIN di n ON n.pair_id = p.pair_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY ALL)
SELECT m.pair_id, sum(m.v)::BIGINT AS mask, sum(op.v)::BIGINT AS opened, sum(cl.v)::BIGINT AS closed FROM m JOIN op USING (pair_id, y, x) JOIN cl USING (pair_id, y, x) GROUP BY 1""")
def morphology(spark: SparkSession, d: str) -> DataFrame:
    """Opening and closing with the full 3 x 3 element; what lies outside the image is unset."""
    h, w, m = F.col("h"), F.col("w"), F.col("m")
    bits = F.transform("d", lambda row: F.transform(row, lambda v: (v >= 40).cast("int")))
    cut = tiled(spark, d, 2, "d").withColumn("m", bits).withColumn("e", S.eroded(m, h + 2, w + 2)).withColumn("g", S.dilated(m, h + 2, w + 2))
    count = lambda plane: F.aggregate(plane, F.lit(0).cast("long"), lambda s, row: s + S.total(row))
    inner = S.core(m, 2, h, w)
    cut = cut.select("pair_id", count(inner).alias("mask"), count(S.dilated(F.col("e"), h, w)).alias("opened"), count(S.eroded(F.col("g"), h, w)).alias("closed"))
    return cut.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in ("mask", "opened", "closed")))


def planes(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, y and the row's values a, b, d as arrays; planes are square."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 240 * v.cast("double")))).cast("long")
    e = T.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", level).alias("p"))
    both = e.where("side = 0").select("pair_id", F.col("p").alias("pa")).join(e.where("side = 1").select("pair_id", F.col("p").alias("pb")), "pair_id")
    both = both.withColumn("w", F.sqrt(F.size("pa")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    row = lambda c: F.slice(c, F.col("y") * F.col("w") + 1, F.col("w"))
    rows = both.select("pair_id", F.col("y").cast("long").alias("y"), row("pa").alias("a"), row("pb").alias("b"))
    return rows.withColumn("d", F.zip_with("a", "b", lambda u, v: F.abs(u - v)))


def components(spark: SparkSession, d: str, cut: int = 60) -> DataFrame:
    """The 8-connected components of differences of at least cut, as labelled runs with their differences in v."""
    return R.labelled(Scratch(spark, "components"), R.of_rows(planes(spark, d), ["pair_id"], "d", lambda v: v >= cut), ["pair_id"])


def set_pixels(parts: DataFrame) -> DataFrame:
    """pair_id, y, x, d, component of labelled runs' pixels."""
    return parts.select("pair_id", "y", "x0", "component", F.posexplode("v").alias("i", "d")).select("pair_id", "y", (F.col("x0") + F.col("i")).alias("x"), "d", "component")


_CC = """,
m AS (SELECT pair_id, y, x, d, y * 8 + x AS i FROM px WHERE d >= 60),
rc AS (SELECT pair_id, i, i AS l FROM m UNION SELECT n.pair_id, n.i, rc.l FROM rc JOIN m p ON p.pair_id = rc.pair_id AND p.i = rc.i JOIN m n ON n.pair_id = p.pair_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1),
root AS (SELECT pair_id, i, min(l) AS root FROM rc GROUP BY 1, 2),
cc AS (SELECT m.*, dense_rank() OVER (PARTITION BY m.pair_id ORDER BY root) AS component FROM m JOIN root USING (pair_id, i))"""


@query("connected_components", WITH + _CC + " SELECT pair_id, y, x, component FROM cc")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return set_pixels(components(spark, d)).drop("d")


@query("zonal_features", WITH + _CC + " SELECT pair_id, component, count(*) AS area, min(x) AS left, min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, max(d) AS peak FROM cc GROUP BY 1, 2")
def zonal_features(spark: SparkSession, d: str) -> DataFrame:
    rows = R.shapes(components(spark, d), ["pair_id"], F.max(F.array_max("v")).alias("peak"))
    return rows.withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("hysteresis", WITH + _CC + " SELECT pair_id, y, x FROM (SELECT *, max(d) OVER (PARTITION BY pair_id, component) AS peak FROM cc) WHERE peak >= 110")
def hysteresis(spark: SparkSession, d: str, high: int = 110) -> DataFrame:
    """Pixels over the low threshold whose component a run of pixels over the high threshold touches."""
    seeds = R.of_rows(planes(spark, d), ["pair_id"], "d", lambda v: v >= high)
    return set_pixels(R.seeded(components(spark, d), seeds, ["pair_id"])).select("pair_id", "y", "x")


@query("annulus_contrast", WITH + _CC + """,
bx AS (SELECT pair_id, component, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, median(d)::DOUBLE AS med FROM cc GROUP BY 1, 2)
SELECT b.pair_id, b.component, count(p.d) AS ring, round(any_value(med) - coalesce(median(p.d), 0)::DOUBLE, 6) AS contrast
FROM bx b LEFT JOIN px p ON p.pair_id = b.pair_id AND p.x BETWEEN x0 - 2 AND x1 + 2 AND p.y BETWEEN y0 - 2 AND y1 + 2 AND p.d < 60 GROUP BY 1, 2""")
def annulus_contrast(spark: SparkSession, d: str) -> DataFrame:
    """A component's median against that of the unset pixels around its box; the range join keeps to the pair's key."""
    px = pixels(spark, d)
    box = set_pixels(components(spark, d)).groupBy("pair_id", "component").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.median("d").alias("med")
    )
    near = px.where("d < 60").select(F.col("pair_id").alias("p"), "y", "x", "d")
    rows = box.join(near, (F.col("pair_id") == F.col("p")) & F.expr("x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2"), "left")
    return rows.groupBy("pair_id", "component").agg(F.count("d").alias("ring"), F.round(F.max("med") - F.coalesce(F.median("d"), F.lit(0.0)), 6).alias("contrast"))


@query("mask_sets", WITH + " SELECT pair_id, count(*) FILTER (a > 150 OR b > 150) AS either, count(*) FILTER (a > 150 AND b > 150) AS both, count(*) FILTER (NOT a > 150) AS holes, count(*) FILTER (a > 150 AND NOT b > 150) AS removed FROM px GROUP BY 1")
def mask_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a") > 150, F.col("b") > 150
    return pixels(spark, d).groupBy("pair_id").agg(F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both"), F.count_if(~a).alias("holes"), F.count_if(a & ~b).alias("removed"))


@query("strided_sample", WITH + " SELECT pair_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY y, x) AS r, count(*) OVER (PARTITION BY pair_id) AS n FROM px WHERE d >= 10) WHERE (r - 1) % greatest(1, n // 12) = 0")
def strided_sample(spark: SparkSession, d: str, samples: int = 12) -> DataFrame:
    """Every k-th eligible pixel in raster order, k by how many there are."""
    stride = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("pair_id")) / samples))
    at = F.row_number().over(Window.partitionBy("pair_id").orderBy("y", "x"))
    return pixels(spark, d).where("d >= 10").withColumn("r", at).withColumn("k", stride).where((F.col("r") - 1) % F.col("k") == 0).select("pair_id", "y", "x")


@query("severe_cells", WITH + """,
c AS (SELECT pair_id, y // 2 AS r, x // 2 AS c, avg(d) AS m FROM px GROUP BY 1, 2, 3 HAVING avg(d) >= 45)
SELECT a.pair_id, a.r AS row, a.c AS col FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE b.pair_id = a.pair_id AND ((b.r = a.r + 1 AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + 1)))""")
def severe_cells(spark: SparkSession, d: str) -> DataFrame:
    """Severe grid cells with a severe neighbour to the right or below."""
    c = pixels(spark, d).groupBy("pair_id", F.floor(F.col("y") / 2).alias("row"), F.floor(F.col("x") / 2).alias("col")).agg(F.avg("d").alias("m")).where("m >= 45").drop("m")
    near = c.select("pair_id", (F.col("row") - 1).alias("row"), "col").unionByName(c.select("pair_id", "row", (F.col("col") - 1).alias("col"))).distinct()
    return c.join(near, ["pair_id", "row", "col"], "left_semi")


@query("masked_mean", WITH + """
SELECT p.pair_id, p.y, p.x, floor(sum(n.d)::DOUBLE / greatest(1, count(n.d)) + 0.5)::BIGINT AS mean
FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - 2 AND p.y + 2 AND n.x BETWEEN p.x - 2 AND p.x + 2 AND n.a > 110 WHERE p.a > 110 GROUP BY 1, 2, 3""")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means over valid neighbours (here: a > 110) of valid pixels."""
    kept = F.zip_with("a", "d", lambda u, v: F.zip_with(u, v, lambda x, y: F.when(x > 110, y)))
    cut = tiled(spark, d, 2, "a", "d").withColumn("v", kept)
    own = S.core(F.col("v"), 2, F.col("h"), F.col("w"))
    rows = dots(cut, own=own, s=moving("v", 2, S.total), n=moving("v", 2, S.present, S.total)).where("own is not null")
    return rows.select("pair_id", "y", "x", F.floor(F.col("s") / F.greatest(F.lit(1), F.col("n")) + 0.5).alias("mean"))


def _lines(axis: str) -> str:
    return f"""(SELECT pair_id, '{axis}' AS axis, i, i - row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM (SELECT pair_id, {axis} AS i, avg((d >= 20 AND grad <= 32)::INT) AS c FROM g GROUP BY 1, 2) WHERE c >= 0.35)"""


@query("overlay_bands", WITH + "," + _GRAD + f""",
r AS (SELECT * FROM {_lines('x')} UNION ALL SELECT * FROM {_lines('y')})
SELECT pair_id, axis, min(i) AS first, max(i) + 1 AS past, count(*) AS n FROM r GROUP BY pair_id, axis, k HAVING count(*) BETWEEN 2 AND 3 AND (min(i) = 0 OR max(i) = 7)""")
def overlay_bands(spark: SparkSession, d: str) -> DataFrame:
    """Flat changed bands at the border: runs of rows or columns that reach it, of a plausible thickness."""
    rows = with_gradient(spark, d)
    out = None
    for axis in "xy":
        size = F.max(axis).over(Window.partitionBy("pair_id")) + 1
        lines = rows.withColumn("size", size).groupBy("pair_id", F.col(axis).alias("i")).agg(F.avg(((F.col("d") >= 20) & (F.col("grad") <= 32)).cast("int")).alias("c"), F.max("size").alias("size")).where("c >= 0.35")
        k = F.col("i") - F.row_number().over(Window.partitionBy("pair_id").orderBy("i"))
        runs = lines.withColumn("k", k).groupBy("pair_id", F.lit(axis).alias("axis"), "k").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("past"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        thin = F.greatest(F.lit(2), F.floor(F.col("size") * 0.45))
        runs = runs.where(F.col("n").between(2, thin) & ((F.col("first") == 0) | (F.col("past") == F.col("size")))).select("pair_id", "axis", "first", "past", "n")
        out = runs if out is None else out.unionByName(runs)
    return out


@query("transformed_residual", WITH + """
SELECT pair_id, y, x, round(abs(a - least(255.0::DOUBLE, greatest(0.0::DOUBLE, b * 0.9::DOUBLE + 7))), 6) AS left_over FROM px""")
def transformed_residual(spark: SparkSession, d: str) -> DataFrame:
    """What a gain of 0.9 and an offset of 7 leave between two planes."""
    return pixels(spark, d).select("pair_id", "y", "x", F.round(F.abs(F.col("a") - F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("b") * 0.9 + 7))), 6).alias("left_over"))


@query("plane_residual", WITH + """,
m AS (SELECT p.pair_id, p.y, p.x, min(abs(p.a - n.b)) AS ab, min(abs(p.b - n.a)) AS ba FROM px p JOIN px n ON n.pair_id = p.pair_id AND n.y BETWEEN p.y - 1 AND p.y + 1 AND n.x BETWEEN p.x - 1 AND p.x + 1 AND n.a > 96 WHERE p.a > 96 GROUP BY ALL)
SELECT pair_id, y, x, floor(0.6::DOUBLE * greatest(ab, ba) + 0.2::DOUBLE * (ab + ba) + 0.5)::BIGINT AS residual FROM m""")
def plane_residual(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric residual of planes; only valid pixels (a > 96) count, on either side."""
    keep = lambda p: F.zip_with("a", p, lambda u, v: F.zip_with(u, v, lambda x, y: F.when(x > 96, y)))
    cut = tiled(spark, d, 1, "a", "b").withColumns({"va": keep("a"), "vb": keep("b")})
    near = lambda p, q: S.nearest(F.col(p), F.col(q), F.col("h"), F.col("w"))
    rows = dots(cut, ab=near("va", "vb"), ba=near("vb", "va")).where("ab is not null and ba is not null")
    return rows.select("pair_id", "y", "x", F.floor(0.6 * F.greatest("ab", "ba") + 0.2 * (F.col("ab") + F.col("ba")) + 0.5).alias("residual"))
