"""Masks as runs: sets of boxes in frames, masks of candidate states, components and holes of frames of unequal sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import runs as R
from parcelflow.operators import trees
from parcelflow.plans import decisions, evaluation
from parcelflow.plans.raster import WITH, planes, set_pixels
from parcelflow.plans.registry import query
from parcelflow.sources import tables as T
from parcelflow.sources.scratch import Scratch

FRAME = 1000


def _cells(rows: str, flags: dict[str, str]) -> str:
    """Common table expressions: cells has, for each pair, the cells between neighbouring edges of its boxes and which masks cover them."""
    cover = ", ".join(f"bool_or({cond} AND {{inside}}) AS {name}" for name, cond in flags.items())
    inside = 'r."left" <= x0 AND r."left" + r.width >= x1 AND r.top <= y0 AND r.top + r.height >= y1'
    edge = lambda axis, low, size: f"SELECT pair_id, e AS {axis}0, lead(e) OVER (PARTITION BY pair_id ORDER BY e) AS {axis}1 FROM (SELECT DISTINCT pair_id, unnest([{low}, {low} + {size}]) AS e FROM {rows})"
    return f"""
ex AS ({edge("x", '"left"', "width")}), ey AS ({edge("y", "top", "height")}),
cells AS (SELECT x.pair_id, x0, x1, y0, y1, (x1 - x0) * (y1 - y0) AS size, {cover.format(inside=inside)} FROM ex x JOIN ey y ON x.pair_id = y.pair_id AND x1 IS NOT NULL AND y1 IS NOT NULL JOIN {rows} r ON r.pair_id = x.pair_id GROUP BY ALL)"""


def found_and_true(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a pair's truths (flag R), of accepted regions (A) and of those to review (N), by mask."""
    rows = R.of_boxes(T.proposals(spark, d), "pair_id", "flag")
    return rows.withColumn("mask", F.when(F.col("flag") == "R", "truth").when(F.col("flag") == "A", "accepted").otherwise("review")).drop("flag")


_PIXELS = f"WITH {T.SQL}," + _cells("proposals", {"truth": "r.flag = 'R'", "accepted": "r.flag = 'A'", "review": "r.flag = 'N'"})


@query("mask_algebra", _PIXELS + f""",
q AS (SELECT *, accepted OR review AS found, lag(x1) OVER w AS before, lag(accepted OR review) OVER w AS open FROM cells WINDOW w AS (PARTITION BY pair_id, y0 ORDER BY x0))
SELECT pair_id, sum(size) FILTER (truth OR found)::BIGINT AS either, coalesce(sum(size) FILTER (truth AND found), 0)::BIGINT AS both, coalesce(sum(size) FILTER (truth AND NOT found), 0)::BIGINT AS only_truth,
  coalesce(sum(size) FILTER (found AND NOT truth), 0)::BIGINT AS only_found, ({FRAME * FRAME} - sum(size) FILTER (truth OR found))::BIGINT AS neither,
  coalesce(sum(y1 - y0) FILTER (found AND NOT coalesce(open AND before = x0, FALSE)), 0)::BIGINT AS found_runs FROM q GROUP BY 1""")
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection, differences and complement of a pair's masks in a frame of 1,000 x 1,000, and the runs of what is found, row by row."""
    c, names = F.col, ["truth", "accepted", "review"]
    cells = R.coverage(Scratch(spark, "masks"), found_and_true(spark, d), ["pair_id"], names)
    found_in = lambda bits: R.has("accepted", names, bits) | R.has("review", names, bits)
    truth, found = R.has("truth", names), found_in("bits")
    cells = cells.select("pair_id", "pixels", truth.alias("truth"), found.alias("found"), F.when(found & ~found_in("before"), c("rows")).otherwise(0).alias("starts"))
    area = lambda w: F.coalesce(F.sum(F.when(w, c("pixels"))), F.lit(0))
    truth, found = c("truth"), c("found")
    either = area(truth | found)  # boxes lie within the frame
    return cells.groupBy("pair_id").agg(
        either.alias("either"), area(truth & found).alias("both"), area(truth & ~found).alias("only_truth"), area(found & ~truth).alias("only_found"), (FRAME * FRAME - either).alias("neither"), F.sum("starts").alias("found_runs")
    )


@query("mask_confusion", _PIXELS + """,
m AS (SELECT pair_id, truth, size, unnest(['accepted', 'all']) AS regions, unnest([accepted, accepted OR review]) AS found FROM cells),
k AS (SELECT pair_id, regions, coalesce(sum(size) FILTER (truth AND found), 0)::BIGINT AS tp, coalesce(sum(size) FILTER (found AND NOT truth), 0)::BIGINT AS fp, coalesce(sum(size) FILTER (truth AND NOT found), 0)::BIGINT AS fn FROM m GROUP BY 1, 2)
SELECT *, round(tp::DOUBLE / greatest(1, tp + fp), 3) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 3) AS recall, round(2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn), 3) AS f1, round(tp::DOUBLE / greatest(1, tp + fp + fn), 3) AS iou FROM k""")
def mask_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of truths that accepted regions, and all regions, find: one sweep over three masks."""
    c, names = F.col, ["truth", "accepted", "review"]
    cells = R.coverage(Scratch(spark, "masks"), found_and_true(spark, d), ["pair_id"], names)
    truth, own, every = R.has("truth", names), R.has("accepted", names), R.has("accepted", names) | R.has("review", names)
    counts = R.added(cells, ["pair_id"], a_tp=truth & own, a_fp=~truth & own, a_fn=truth & ~own, b_tp=truth & every, b_fp=~truth & every, b_fn=truth & ~every)
    both = F.array(*(F.struct(F.lit(n).alias("regions"), *(c(f"{s}_{k}").alias(k) for k in ("tp", "fp", "fn"))) for n, s in (("accepted", "a"), ("all", "b"))))
    rows = counts.select("pair_id", F.inline(both))
    return rows.withColumns(evaluation.confusion(c("tp"), c("fp"), c("fn")))


_STATES = ("accepted", "needs_review", "rejected")
_OPINION = decisions._G.removeprefix("\n") + """,
m AS (SELECT pair_id, candidate_id, ['physical_change', 'likely_artifact', 'maybe', 'uncertain'][(area % 4 + 1)::INT] AS decision FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, candidate_id ORDER BY area) AS r FROM c WHERE area % 5 <> 0) WHERE r = 1),
o AS (SELECT s.pair_id, s.candidate_id, s.state AS before, CASE WHEN s.state = 'rejected' OR m.decision IS NULL THEN s.state WHEN m.decision = 'physical_change' THEN 'accepted'
  WHEN m.decision = 'likely_artifact' AND NOT (area % 6 > 0 AND score >= 0.5 AND structural >= 0.2 AND contrast >= 0.12) THEN 'rejected' ELSE 'needs_review' END AS after FROM s LEFT JOIN m USING (pair_id, candidate_id)),
b AS (SELECT DISTINCT p.pair_id, p."left", p.top, p.width, p.height, o.before, o.after FROM proposals p JOIN o ON o.pair_id = p.pair_id AND o.candidate_id = p.proposal_id)"""


@query("state_mask_areas", f"WITH {T.SQL}," + _OPINION + "," + _cells("b", {f"{w}_{s}": f"r.{w} = '{s}'" for w in ("before", "after") for s in _STATES}) + """
SELECT pair_id, """ + ", ".join(f"coalesce(sum(size) FILTER ({w}_{s}), 0)::BIGINT AS {w}_{s}" for w in ("before", "after") for s in _STATES) + """,
  coalesce(sum(size) FILTER (before_accepted OR before_needs_review), 0)::BIGINT AS before_shown, coalesce(sum(size) FILTER (after_accepted OR after_needs_review), 0)::BIGINT AS after_shown,
  coalesce(sum(size) FILTER ((before_accepted OR before_needs_review) <> (after_accepted OR after_needs_review)), 0)::BIGINT AS altered FROM cells GROUP BY 1""")
def state_mask_areas(spark: SparkSession, d: str) -> DataFrame:
    """A pair's masks by candidate state before a second opinion and rebuilt after it: pixels of each, of what is shown, and of what differs."""
    moved = decisions.transitions(spark, d).select("pair_id", F.col("candidate_id").alias("proposal_id"), "before", "after")
    rows = R.of_boxes(T.proposals(spark, d).join(moved, ["pair_id", "proposal_id"]), "pair_id", "before", "after")
    when = [F.concat(F.lit(f"{w}_"), F.col(w)) for w in ("before", "after")]
    rows = rows.withColumn("mask", F.explode(F.array(*when))).drop("before", "after")
    names = [f"{w}_{s}" for w in ("before", "after") for s in _STATES]
    held = {n: R.has(n, names) for n in names}
    shown = {w: held[f"{w}_accepted"] | held[f"{w}_needs_review"] for w in ("before", "after")}
    return R.added(R.coverage(Scratch(spark, "states"), rows, ["pair_id"], names), ["pair_id"], **held, before_shown=shown["before"], after_shown=shown["after"], altered=shown["before"] != shown["after"])


TILES = 12


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """scene_id, y and rows of values a, b, d: planes of up to 12 pairs side by side, three or four in a row, so frames differ in size."""
    k, wide = F.col("pair_id") % TILES, 3 + F.floor(F.col("pair_id") / TILES) % 2
    rows = planes(spark, d).withColumn("_c", (k % wide).cast("int")).withColumn("_y", F.floor(k / wide) * 8 + F.col("y"))
    rows = rows.groupBy(F.floor(F.col("pair_id") / TILES).alias("scene_id"), F.col("_y").alias("y")).agg(F.sort_array(F.collect_list(F.struct("_c", "a", "b", "d"))).alias("t"))
    return rows.select("scene_id", "y", *(F.flatten(f"t.{c}").alias(c) for c in "abd"))


def scene_frames(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scene_id").agg(F.max(F.size("d")).cast("long").alias("width"), (F.max("y") + 1).alias("height"))


_SCENE = """,
sp AS (SELECT s AS scene_id, (k // w) * 8 + y AS y, (k % w) * 8 + x AS x, a, b, d FROM (SELECT *, pair_id // 12 AS s, pair_id % 12 AS k, 3 + (pair_id // 12) % 2 AS w FROM px))"""


def _parts(name: str, rows: str, four: bool = False, key: str = "scene_id") -> str:
    """Common table expressions: {name} has rows (key, y, x, i, ...) with component."""
    near = "abs(n.y - p.y) + abs(n.x - p.x) = 1" if four else "abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 AND n.i <> p.i"
    keys = key.split(", ")
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return f"""
{name}_m AS ({rows}),
{name}_e AS (SELECT {of("p")}, p.i, n.i AS j FROM {name}_m p JOIN {name}_m n ON {same("n", "p")} AND {near}),
{name}_r AS (SELECT {key}, i, i AS l FROM {name}_m UNION SELECT {of("e")}, e.j, r.l FROM {name}_r r JOIN {name}_e e ON {same("e", "r")} AND e.i = r.i AND r.l < e.j),
{name} AS (SELECT m.*, dense_rank() OVER (PARTITION BY {of("m")} ORDER BY l) AS component FROM {name}_m m JOIN (SELECT {key}, i, min(l) AS l FROM {name}_r GROUP BY ALL) USING ({key}, i))"""


_LOW = "SELECT *, y * 1000 + x AS i FROM sp WHERE d >= 60"
_SHAPE = 'count(*) AS area, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy'
KEY = ["scene_id"]


def scene_parts(scratch: Scratch, rows: DataFrame, cut: int = 60) -> DataFrame:
    return R.labelled(scratch, R.of_rows(rows, KEY, "d", lambda v: v >= cut), KEY)


@query("scene_components", WITH + _SCENE + "," + _parts("c", _LOW) + f" SELECT scene_id, component, {_SHAPE}, max(d) AS peak, round(avg(d), 6) AS mean FROM c GROUP BY 1, 2")
def scene_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of frames of unequal sizes with their shapes and levels, from runs alone."""
    parts = scene_parts(Scratch(spark, "scenes"), scenes(spark, d))
    total = F.sum(F.aggregate("v", F.lit(0).cast("long"), lambda s, v: s + v))
    rows = R.shapes(parts, KEY, F.max(F.array_max("v")).alias("peak"), (total / F.sum(F.size("v"))).alias("mean"))
    return rows.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "mean")})


@query("scene_holes", WITH + _SCENE + """,
fr AS (SELECT scene_id, max(x) + 1 AS w, max(y) + 1 AS h FROM sp GROUP BY 1),
al AS (SELECT scene_id, w, h, y, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM fr)),""" + _parts("c", "SELECT al.*, y * 1000 + x AS i FROM al LEFT JOIN sp USING (scene_id, y, x) WHERE coalesce(d, 0) < 30", four=True) + """
SELECT scene_id, min(y * 1000 + x) AS first, """ + _SHAPE + " FROM c GROUP BY scene_id, component HAVING NOT bool_or(x = 0 OR y = 0 OR x = w - 1 OR y = h - 1)")
def scene_holes(spark: SparkSession, d: str, cut: int = 30) -> DataFrame:
    """Holes of the masks of weak differences: 4-connected parts of the complement within the frame."""
    rows = scenes(spark, d)
    mask = R.of_rows(rows, KEY, "d", lambda v: v >= cut).drop("v")
    parts = R.holes(Scratch(spark, "holes"), mask, scene_frames(rows), KEY)
    return R.shapes(parts, KEY, F.min(F.col("y") * 1000 + F.col("x0")).alias("first")).drop("component").withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("seed_touch", WITH + _SCENE + "," + _parts("c", _LOW) + """,
sd AS (SELECT scene_id, y, x FROM sp WHERE b >= 170)
SELECT scene_id, component, count(*) AS area, count(sd.x) AS seeds FROM c LEFT JOIN sd USING (scene_id, y, x) GROUP BY 1, 2 HAVING count(sd.x) > 0""")
def seed_touch(spark: SparkSession, d: str) -> DataFrame:
    """Components of the low mask that seeds of another mask touch (here: bright in the later plane), and in how many pixels."""
    rows = scenes(spark, d)
    parts = scene_parts(Scratch(spark, "seeds"), rows)
    seeds = R.of_rows(rows, KEY, "b", lambda v: v >= 170)
    met = R.touching(parts, seeds, KEY, 0).select("scene_id", "y", F.col("ax0").alias("x0"), (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")).alias("n"))
    met = parts.select("scene_id", "y", "x0", "component").join(met, ["scene_id", "y", "x0"]).groupBy("scene_id", "component").agg(F.sum("n").alias("seeds"))
    kept = R.seeded(parts, seeds, KEY).groupBy("scene_id", "component").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return kept.join(met, ["scene_id", "component"])


LEVELS = (60, 75, 90, 105, 120)
_TREE = WITH + _SCENE + "," + _parts("c", f"SELECT sp.*, y * 1000 + x AS i, level FROM sp JOIN (SELECT unnest({list(LEVELS)}) AS level) ON d >= level", key="scene_id, level") + """,
n AS (SELECT scene_id, level, component, count(*) AS area, min(i) AS i, max(d) AS peak FROM c GROUP BY 1, 2, 3),
t AS (SELECT n.*, p.component AS parent, b.component AS base FROM n LEFT JOIN c p ON p.scene_id = n.scene_id AND p.level = n.level - 15 AND p.i = n.i JOIN c b ON b.scene_id = n.scene_id AND b.level = 60 AND b.i = n.i)"""


def scene_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return trees.component_tree(Scratch(spark, "tree"), scenes(spark, d), KEY, "d", list(LEVELS))


@query("component_tree", _TREE + " SELECT scene_id, level, component, parent, base, area, peak, i AS first FROM t")
def component_tree(spark: SparkSession, d: str) -> DataFrame:
    """Components of all thresholds of frames of unequal sizes, each with its parent at the threshold below."""
    nodes, _ = scene_tree(spark, d)
    return nodes.select("scene_id", "level", "component", "parent", "base", "area", "peak", (F.col("y") * 1000 + F.col("x")).alias("first"))


@query("component_splits", _TREE + """,
k AS (SELECT scene_id, base AS component, level, count(*) AS cores, sum(area)::BIGINT AS core_area FROM t WHERE area >= 3 GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT scene_id, component, level, cores, core_area FROM k QUALIFY level = min(level) OVER (PARTITION BY scene_id, component)""")
def component_splits(spark: SparkSession, d: str) -> DataFrame:
    """Weakly joined components: where they fall into several cores of at least three pixels."""
    return trees.splits(scene_tree(spark, d)[0], KEY, 3)


@query("threshold_stability", _TREE + """,
w AS (SELECT scene_id, base AS component, level, count(*) AS parts, sum(area)::BIGINT AS pixels FROM t GROUP BY 1, 2, 3),
m AS (SELECT scene_id, component, median(d)::DOUBLE AS med, count(*) AS area, count(*) FILTER (d >= 60 * 1.12::DOUBLE) AS core, count(*) FILTER (d >= 105) AS seeds FROM c WHERE level = 60 GROUP BY 1, 2)
SELECT m.scene_id, m.component, string_agg(w.level || ':' || w.parts || ':' || w.pixels, ' ' ORDER BY w.level) AS survival,
  round(least(1.0::DOUBLE, least(1.0::DOUBLE, any_value(core)::DOUBLE / any_value(area) / 0.55::DOUBLE) * 0.42::DOUBLE + least(1.0::DOUBLE, any_value(seeds)::DOUBLE / any_value(area) / 0.12::DOUBLE) * 0.34::DOUBLE + least(1.0::DOUBLE, (any_value(med) - 60) / 45) * 0.24::DOUBLE), 6) AS stability
FROM m JOIN w USING (scene_id, component) GROUP BY 1, 2""")
def threshold_stability(spark: SparkSession, d: str, low: int = 60, high: int = 105) -> DataFrame:
    """What of a component stands at each threshold, and how stable that makes it."""
    nodes, parts = scene_tree(spark, d)
    by = trees.survival(nodes, KEY).groupBy("scene_id", "component").agg(F.sort_array(F.collect_list(F.struct("level", "parts", "pixels"))).alias("s"))
    told = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["level"], x["parts"], x["pixels"])), " ")
    flat = parts.where(F.col("level") == low).select("scene_id", "component", F.explode("v").alias("d")).groupBy("scene_id", "component").agg(
        F.median("d").alias("m"), F.avg((F.col("d") >= low * 1.12).cast("int")).alias("core"), F.avg((F.col("d") >= high).cast("int")).alias("seeds")
    )
    value = trees.stability(F.col("m"), F.col("core"), F.col("seeds"), F.lit(low), F.lit(high))
    return by.join(flat, ["scene_id", "component"]).select("scene_id", "component", told.alias("survival"), F.round(value, 6).alias("stability"))
