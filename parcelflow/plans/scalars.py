"""Small expressions: boxes and grids, transforms, texts, counters, first rows, unions of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import boxes as B
from parcelflow.plans import decisions, geometry
from parcelflow.plans.raster import WITH, frames, pixels, spread, with_gradient, _GRAD
from parcelflow.plans.registry import query
from parcelflow.sources import tables as T

_FRAME = 1000


@query("percent_boxes", geometry.WITH + """,
q AS (SELECT *, least(1000, greatest(0, "left" * 2 - 200)) AS x, least(1000, greatest(0, top * 2 - 150)) AS y FROM proposals)
SELECT pair_id, proposal_id, x * 100.0::DOUBLE / 1000 AS x_pct, y * 100.0::DOUBLE / 1000 AS y_pct, least(1000 - x, width) * 100.0::DOUBLE / 1000 AS w_pct, least(1000 - y, height) * 100.0::DOUBLE / 1000 AS h_pct,
  greatest(0, 30, "left" - 24) AS crop_left, greatest(0, 20, top - 24) AS crop_top, greatest(0, least(1000, 930, "left" + width + 24) - greatest(0, 30, "left" - 24)) AS crop_width, greatest(0, least(1000, 920, top + height + 24) - greatest(0, 20, top - 24)) AS crop_height,
  "left" >= 100 AND "left" < 400 AND top >= 50 AND top < 450 AS corner_inside FROM q""")
def percent_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clamped to the frame in percent, padded within a viewport (30, 20, 900, 900), and whether their corner lies in a box."""
    at = {n: F.least(F.lit(_FRAME), F.greatest(F.lit(0), F.col(c) * 2 - off)) for n, c, off in (("x", "left", 200), ("y", "top", 150))}
    pct = lambda v: v * 100.0 / _FRAME
    crop = padded("left", "top", "width", "height", 24, (_FRAME, _FRAME), (30, 20, 900, 900))
    return T.proposals(spark, d).select(
        "pair_id", "proposal_id", pct(at["x"]).alias("x_pct"), pct(at["y"]).alias("y_pct"), pct(F.least(_FRAME - at["x"], F.col("width"))).alias("w_pct"), pct(F.least(_FRAME - at["y"], F.col("height"))).alias("h_pct"),
        *(v.alias(f"crop_{k}") for k, v in crop.items()), point_in_box(F.col("left"), F.col("top"), 100, 50, 300, 400).alias("corner_inside"),
    )


def padded(left: str, top: str, width: str, height: str, pad: int, frame: tuple[int, int], view: tuple[int, int, int, int]) -> dict[str, Column]:
    """A box widened on all sides, inside the frame and the viewport."""
    out = {}
    for at, size, n, of, low, span in ((left, width, "left", frame[0], view[0], view[2]), (top, height, "top", frame[1], view[1], view[3])):
        a = F.greatest(F.lit(0), F.lit(low), F.col(at) - pad)
        out[n] = a
        out["width" if n == "left" else "height"] = F.greatest(F.lit(0), F.least(F.lit(of), F.lit(low + span), F.col(at) + F.col(size) + pad) - a)
    return {k: out[k] for k in ("left", "top", "width", "height")}


def point_in_box(x: Column, y: Column, left: int, top: int, width: int, height: int) -> Column:
    """Left and top edges belong to the box, right and bottom ones don't."""
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


@query("percent_iou", geometry.WITH + """
SELECT a.pair_id, a.proposal_id, round(o / CASE WHEN a.width * a.height + 40000 - o = 0 THEN 1 ELSE a.width * a.height + 40000 - o END, 6) AS iou
FROM (SELECT *, (greatest(0, least("left" + width, 400) - greatest("left", 200)) * greatest(0, least(top + height, 400) - greatest(top, 200)))::DOUBLE AS o FROM proposals) a""")
def percent_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap over union with one region asked for."""
    o = F.greatest(F.lit(0), F.least(F.col("left") + F.col("width"), F.lit(400)) - F.greatest("left", F.lit(200))) * F.greatest(F.lit(0), F.least(F.col("top") + F.col("height"), F.lit(400)) - F.greatest("top", F.lit(200)))
    union = F.col("width") * F.col("height") + 40000 - o
    return T.proposals(spark, d).select("pair_id", "proposal_id", F.round(o / F.when(union == 0, 1).otherwise(union), 6).alias("iou"))


@query("grid_cells", """
WITH f AS (SELECT o_orderkey AS pair_id, 500 + o_orderkey % 777 AS w, 400 + o_orderkey % 555 AS h FROM orders), g AS (SELECT f.*, r, c FROM f, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(4)) AS c))
SELECT pair_id, r AS row, c AS col, c * w // 4 AS left, r * h // 4 AS top, (c + 1) * w // 4 - c * w // 4 AS width, (r + 1) * h // 4 - r * h // 4 AS height FROM g""")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a 4 x 4 grid over each frame; whole pixels, without gaps."""
    k = F.col("o_orderkey")
    n = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    rows = T.read(spark, d, "orders").select(k.alias("pair_id"), (500 + k % 777).alias("w"), (400 + k % 555).alias("h"), F.explode(n).alias("row")).withColumn("col", F.explode(n))
    at = lambda i, size: F.floor(F.col(i) * F.col(size) / 4)
    end = lambda i, size: F.floor((F.col(i) + 1) * F.col(size) / 4)
    return rows.select("pair_id", "row", "col", at("col", "w").alias("left"), at("row", "h").alias("top"), (end("col", "w") - at("col", "w")).alias("width"), (end("row", "h") - at("row", "h")).alias("height"))


def trace_roi(x: Column, y: Column, width: Column, height: Column, radius: Column, frame: tuple[int, int]) -> Column:
    """A region asked for, on the canvas: a radius (rounded) makes a square around the point; at least one pixel is left."""
    r = F.when(radius.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(float(max(frame))), F.floor(radius + 0.5).cast("double"))))
    side = F.when(r.isNotNull(), r * 2 + 1)
    place = lambda v, most: F.least(F.lit(max(0, most - 1)), F.greatest(F.lit(0), F.floor(F.when(r.isNull(), v).otherwise(v - r)))).cast("long")
    size = lambda v, at, most: F.greatest(F.lit(1), F.least(F.lit(most) - at, F.ceil(F.coalesce(side, v)))).cast("long")
    ax, ay = place(x, frame[0]), place(y, frame[1])
    return F.struct(ax.alias("x"), ay.alias("y"), size(width, ax, frame[0]).alias("width"), size(height, ay, frame[1]).alias("height"))


@query("trace_rois", geometry.WITH + """,
q AS (SELECT pair_id, proposal_id, "left" * 3 - 200.5::DOUBLE AS x, top * 3 - 100.25::DOUBLE AS y, width * 1.5::DOUBLE AS w, height * 1.5::DOUBLE AS h, CASE WHEN small_object THEN height + 0.5::DOUBLE END AS r FROM proposals),
s AS (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(1.0::DOUBLE, least(1000.0::DOUBLE, floor(r + 0.5))) END AS rr FROM q),
p AS (SELECT *, least(999, greatest(0, floor(CASE WHEN rr IS NULL THEN x ELSE x - rr END)::BIGINT)) AS ax, least(799, greatest(0, floor(CASE WHEN rr IS NULL THEN y ELSE y - rr END)::BIGINT)) AS ay FROM s)
SELECT pair_id, proposal_id, ax AS x, ay AS y, greatest(1, least(1000 - ax, ceil(coalesce(rr * 2 + 1, w))::BIGINT)) AS width, greatest(1, least(800 - ay, ceil(coalesce(rr * 2 + 1, h))::BIGINT)) AS height FROM p""")
def trace_rois(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    roi = trace_roi(c("left") * 3 - 200.5, c("top") * 3 - 100.25, c("width") * 1.5, c("height") * 1.5, F.when(c("small_object"), c("height") + 0.5), (1000, 800))
    return T.proposals(spark, d).select("pair_id", "proposal_id", roi.alias("r")).select("pair_id", "proposal_id", "r.*")


@query("roi_evidence", WITH + """,
z AS (SELECT *, x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AS inside, a > 96 AS valid FROM px)
SELECT pair_id, count(*) FILTER (inside AND valid) AS valid_pixels, round(count(*) FILTER (inside AND valid) * 100.0::DOUBLE / 16, 3) AS valid_pct,
  round(count(*) FILTER (inside AND (x IN (2, 5) OR y IN (2, 5)) AND NOT valid) / 12.0::DOUBLE, 3) AS border_contact, round((coalesce(median(d) FILTER (inside AND valid), 0) - coalesce(median(d) FILTER (NOT inside AND valid), 0))::DOUBLE / 255, 3) AS contrast,
  round(coalesce(avg(d) FILTER (inside AND valid), 0) / 255, 3) AS mean, max(d) FILTER (inside AND valid) AS peak, count(*) FILTER (inside AND d >= 60) AS low_pixels, count(*) FILTER (inside AND d >= 110) AS high_pixels FROM z GROUP BY 1""")
def roi_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence inside a region against the ring around it, and how much of its border isn't valid."""
    x, y, dd = F.col("x"), F.col("y"), F.col("d")
    inside, valid = x.between(2, 5) & y.between(2, 5), F.col("a") > 96
    some = lambda c: F.when(c, dd)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    rim = inside & (x.isin(2, 5) | y.isin(2, 5)) & ~valid
    return pixels(spark, d).groupBy("pair_id").agg(
        F.count_if(inside & valid).alias("valid_pixels"), F.round(F.count_if(inside & valid) * 100.0 / 16, 3).alias("valid_pct"), F.round(F.count_if(rim) / 12.0, 3).alias("border_contact"),
        F.round((zero(F.median(some(inside & valid))) - zero(F.median(some(~inside & valid)))) / 255, 3).alias("contrast"), F.round(zero(F.avg(some(inside & valid))) / 255, 3).alias("mean"),
        F.max(some(inside & valid)).alias("peak"), F.count_if(inside & (dd >= 60)).alias("low_pixels"), F.count_if(inside & (dd >= 110)).alias("high_pixels"),
    )


@query("roi_trace", geometry.WITH + """
SELECT pair_id, section, proposal_id, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, section ORDER BY proposal_id) AS r FROM (
  SELECT pair_id, proposal_id, CASE WHEN source LIKE 'frontier%' THEN 'raw_proposals' ELSE 'candidates' END AS section FROM proposals p WHERE p."left" < 400 AND 100 < p."left" + p.width AND p.top < 300 AND 100 < p.top + p.height)) WHERE r <= 200""")
def roi_trace(spark: SparkSession, d: str, most: int = 200) -> DataFrame:
    """What touches a region, by section; a section lists so many rows at most, which is its purpose."""
    c = F.col
    touches = (c("left") < 400) & (c("left") + c("width") > 100) & (c("top") < 300) & (c("top") + c("height") > 100)
    rows = T.proposals(spark, d).where(touches).withColumn("section", F.when(c("source").startswith("frontier"), "raw_proposals").otherwise("candidates"))
    at = F.row_number().over(Window.partitionBy("pair_id", "section").orderBy("proposal_id"))
    return rows.withColumn("place", at).where(c("place") <= most).select("pair_id", "section", "proposal_id", "place")


@query("homography_product", """
WITH m AS (SELECT c_custkey AS k, [1 + c_custkey % 7, c_custkey % 5, c_custkey % 11, c_custkey % 3, 2 + c_custkey % 4, c_custkey % 13, 0, c_custkey % 2, 1]::BIGINT[] AS a, [2, 1, c_custkey % 9, 0, 3, c_custkey % 6, 1, 0, 1]::BIGINT[] AS b FROM customer)
SELECT k, array_to_string(list_transform(range(9), lambda i: a[3 * (i // 3) + 1] * b[i % 3 + 1] + a[3 * (i // 3) + 2] * b[3 + i % 3 + 1] + a[3 * (i // 3) + 3] * b[6 + i % 3 + 1]), ',') AS product FROM m""")
def homography_product(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.array(*(x.cast("long") for x in (1 + k % 7, k % 5, k % 11, k % 3, 2 + k % 4, k % 13, F.lit(0), k % 2, F.lit(1))))
    b = F.array(*(x.cast("long") for x in (F.lit(2), F.lit(1), k % 9, F.lit(0), F.lit(3), k % 6, F.lit(1), F.lit(0), F.lit(1))))
    return T.read(spark, d, "customer").select(k.alias("k"), F.array_join(product(a, b).cast("array<string>"), ",").alias("product"))


def product(a: Column, b: Column) -> Column:
    """Of two row-major 3 x 3 matrices."""
    return F.array(*(sum((a[3 * r + i] * b[3 * i + c] for i in range(1, 3)), a[3 * r] * b[c]) for r in range(3) for c in range(3)))


@query("provider_messages", """
WITH b AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"error":{"message":"limit of user ' || user_id || '"}}' WHEN 1 THEN '{"error":{}}' WHEN 2 THEN 'no json <' ELSE '{"error":{"message":"' || repeat('x', 600) || '"}}' END AS body, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 40 END AS v, repeat('failed ', 1 + (event_id % 80)::INT) AS err FROM events)
SELECT id, CASE WHEN NOT json_valid(body) THEN 'Provider returned an unreadable error.' ELSE coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.error.message'), 'Provider rejected the request.')[:500] END AS message,
  CASE WHEN v IS NULL THEN 0 ELSE greatest(0, floor(v + 0.5)::BIGINT) END AS tokens, err[:300] AS error FROM b""")
def provider_messages(spark: SparkSession, d: str) -> DataFrame:
    """Readable messages of refusals, whole numbers of tokens, errors cut to a length."""
    k = F.col("event_id")
    body = F.when(k % 4 == 0, F.concat(F.lit('{"error":{"message":"limit of user '), "user_id", F.lit('"}}'))).when(k % 4 == 1, '{"error":{}}').when(k % 4 == 2, "no json <").otherwise(F.lit('{"error":{"message":"' + "x" * 600 + '"}}'))
    return T.read(spark, d, "events").select(
        k.alias("id"), safe_message(body).alias("message"), nonnegative(F.when(k % 5 != 0, F.col("value") - 40)).alias("tokens"), F.substring(F.expr("repeat('failed ', cast(1 + event_id % 80 as int))"), 1, 300).alias("error")
    )


def safe_message(body: Column) -> Column:
    """error.message of a JSON body, or a default; another default for what is no JSON."""
    told = F.get_json_object(body, "$.error.message")
    return F.when(F.get_json_object(body, "$").isNull(), "Provider returned an unreadable error.").otherwise(F.substring(F.coalesce(told, F.lit("Provider rejected the request.")), 1, 500))


def nonnegative(v: Column) -> Column:
    """Rounded, 0 at least; 0 for what is no finite number."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(ok, F.greatest(F.lit(0), B.half_up(v))).otherwise(0).cast("long")


# Titles of results by state.
TITLES = {
    "NO_DIFFERENCE_EVIDENCE": "No difference evidence found", "EVIDENCE_BELOW_THRESHOLD": "Difference evidence below threshold", "COMPONENTS_REJECTED": "Candidate components were rejected",
    "REGISTRATION_UNRELIABLE": "Registration unreliable", "COMPATIBILITY_FAILURE": "Image compatibility failure", "CANDIDATE_SATURATION": "Candidate limit reached",
    "WIDESPREAD_CHANGE_REVIEW": "Widespread change requires review", "RESOURCE_LIMIT_EXCEEDED": "Image exceeds processing limits",
}


def title(state: Column, accepted: Column, review: Column) -> Column:
    """A result's title; three states tell their numbers."""
    many = lambda n, one, more: F.when(n == 1, one).otherwise(more)
    out = F.when(state == "CHANGES_DETECTED", F.concat(accepted.cast("string"), F.lit(" potential change "), many(accepted, "region", "regions")))
    out = out.when(state == "CHANGES_NEED_REVIEW", F.concat(review.cast("string"), F.lit(" candidate "), many(review, "needs", "need"), F.lit(" review")))
    out = out.when(state == "CHANGES_DETECTED_WITH_REVIEW", F.concat(accepted.cast("string"), F.lit(" accepted and "), review.cast("string"), F.lit(" review candidates")))
    for k, v in TITLES.items():
        out = out.when(state == k, v)
    return out


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())


@query("result_titles", "WITH" + decisions._G + f"""
SELECT pair_id, CASE WHEN a > 0 AND v > 0 THEN a || ' accepted and ' || v || ' review candidates' WHEN a > 0 THEN a || ' potential change ' || CASE a WHEN 1 THEN 'region' ELSE 'regions' END
  WHEN v > 0 THEN v || ' candidate ' || CASE v WHEN 1 THEN 'needs' ELSE 'need' END || ' review' ELSE CASE ['COMPONENTS_REJECTED', 'NO_DIFFERENCE_EVIDENCE', 'EVIDENCE_BELOW_THRESHOLD', 'REGISTRATION_UNRELIABLE', 'COMPATIBILITY_FAILURE', 'CANDIDATE_SATURATION', 'WIDESPREAD_CHANGE_REVIEW', 'RESOURCE_LIMIT_EXCEEDED'][pair_id % 8 + 1] {_CASES} END END AS title,
  floor(100 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, best)) + 0.5)::BIGINT || '%' AS best
FROM (SELECT pair_id, count(*) FILTER (state = 'accepted') AS a, count(*) FILTER (state = 'needs_review') AS v, max(score) AS best FROM s GROUP BY 1)""")
def result_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles by state and number, and the best score as a percentage."""
    n = lambda s: F.count_if(F.col("state") == s)
    rows = decisions.judged(spark, d).groupBy("pair_id").agg(n("accepted").alias("a"), n("needs_review").alias("v"), F.max("score").alias("best"))
    a, v = F.col("a"), F.col("v")
    names = ("COMPONENTS_REJECTED", "NO_DIFFERENCE_EVIDENCE", "EVIDENCE_BELOW_THRESHOLD", "REGISTRATION_UNRELIABLE", "COMPATIBILITY_FAILURE", "CANDIDATE_SATURATION", "WIDESPREAD_CHANGE_REVIEW", "RESOURCE_LIMIT_EXCEEDED")
    state = F.when((a > 0) & (v > 0), "CHANGES_DETECTED_WITH_REVIEW").when(a > 0, "CHANGES_DETECTED").when(v > 0, "CHANGES_NEED_REVIEW").otherwise(T.pick(names, F.col("pair_id") % 8))
    return rows.select("pair_id", title(state, a, v).alias("title"), percent(F.col("best")).alias("best"))


def percent(v: Column) -> Column:
    return F.concat(B.half_up(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0))))).cast("string"), F.lit("%"))


@query("candidate_union", "WITH" + decisions._G + """,
u AS (SELECT pair_id, candidate_id, 1 AS part FROM s WHERE state = 'accepted' UNION ALL SELECT pair_id, candidate_id, 2 FROM s WHERE state = 'needs_review' UNION ALL SELECT pair_id, candidate_id, 3 FROM s WHERE state = 'rejected')
SELECT pair_id, count(*) AS n, count(DISTINCT candidate_id) AS ids, (count(*) FILTER (part = 3)) AS rejected FROM u GROUP BY 1""")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Accepted, reviewed and rejected candidates as one bag."""
    rows = decisions.judged(spark, d)
    part = lambda s, n: rows.where(F.col("state") == s).select("pair_id", "candidate_id", F.lit(n).alias("part"))
    both = part("accepted", 1).unionByName(part("needs_review", 2)).unionByName(part("rejected", 3))
    return both.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_id").alias("ids"), F.count_if(F.col("part") == 3).alias("rejected"))


@query("region_diagnostics", "WITH" + decisions._G + """,
r AS (SELECT pair_id, candidate_id, round(sqrt(width * height) * (0.45::DOUBLE + density + median), 3) AS rank_value FROM s WHERE state <> 'rejected')
SELECT r.pair_id, r.candidate_id, r.rank_value, s.state, round(s.score, 3) AS score, round(s.stability, 3) AS stability, round(s.density, 3) AS density, array_to_string(s.reasons, ',') AS reasons FROM r LEFT JOIN s USING (pair_id, candidate_id)""")
def region_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Regions with the diagnostics of the candidate they come from."""
    rows = decisions.judged(spark, d)
    value = F.sqrt(F.col("width") * F.col("height")) * (0.45 + F.col("density") + F.col("inside_mean"))
    region = rows.where("state <> 'rejected'").select("pair_id", "candidate_id", F.round(value, 3).alias("rank_value"))
    told = rows.select("pair_id", "candidate_id", "state", *(F.round(c, 3).alias(c) for c in ("score", "stability", "density")), F.array_join("reasons", ",").alias("reasons"))
    return region.join(told, ["pair_id", "candidate_id"], "left")


@query("newest_alert", f"WITH {T.SQL} SELECT alert_key, type, detected_at FROM alerts ORDER BY detected_at DESC, alert_key LIMIT 1")
def newest_alert(spark: SparkSession, d: str) -> DataFrame:
    return T.alerts(spark, d).select("alert_key", "type", "detected_at").orderBy(F.desc("detected_at"), "alert_key").limit(1)


@query("largest_shape", geometry.WITH + """
SELECT pair_id, proposal_id, area FROM (SELECT pair_id, proposal_id, width * height AS area, row_number() OVER (PARTITION BY pair_id ORDER BY width * height DESC, proposal_id) AS r FROM proposals) WHERE r = 1""")
def largest_shape(spark: SparkSession, d: str) -> DataFrame:
    """The largest shape of each pair, the first of equals."""
    best = F.max(F.struct((F.col("width") * F.col("height")).alias("area"), (-F.col("proposal_id")).alias("id"))).alias("m")
    return T.proposals(spark, d).groupBy("pair_id").agg(best).select("pair_id", (-F.col("m.id")).alias("proposal_id"), F.col("m.area").alias("area"))


@query("point_coverage", geometry.WITH + """
SELECT pair_id, count(*) AS points, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE round((max("left") - min("left")) * (max(top) - min(top)) / 810000.0::DOUBLE, 6) END AS coverage FROM proposals GROUP BY 1""")
def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Area that points span, over the viewport's (900 x 900)."""
    span = lambda c: F.max(c) - F.min(c)
    return T.proposals(spark, d).groupBy("pair_id").agg(F.count(F.lit(1)).alias("points"), (F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.round(span("left") * span("top") / 810000.0, 6))).alias("coverage"))


@query("input_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def input_digest(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


@query("threshold_exclusions", WITH + "," + _GRAD + """,
w AS (SELECT g.*, px.a, px.b FROM g JOIN px USING (pair_id, y, x))
SELECT pair_id, CASE WHEN y = 0 THEN 'ui_or_viewport' WHEN a < 40 THEN 'invalid_overlap' WHEN grad > 38 THEN 'strong_gradient' WHEN b > 200 THEN 'registration_residual' WHEN d >= 90 THEN 'provisional_change' WHEN d >= 70 THEN 'structural_change' WHEN d > 54 THEN 'color_change' ELSE 'stable' END AS reason, count(*) AS n FROM w GROUP BY 1, 2""")
def threshold_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why a pixel doesn't count as background: the first reason that holds."""
    c = F.col
    reason = (
        F.when(c("y") == 0, "ui_or_viewport").when(c("a") < 40, "invalid_overlap").when(c("grad") > 38, "strong_gradient").when(c("b") > 200, "registration_residual").when(c("d") >= 90, "provisional_change")
        .when(c("d") >= 70, "structural_change").when(c("d") > 54, "color_change").otherwise("stable")
    )
    return with_gradient(spark, d).groupBy("pair_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("mask_percentages", WITH + "," + _GRAD + """
SELECT pair_id, round(count(*) FILTER (d >= 110) * 100.0::DOUBLE / greatest(1, count(*) FILTER (d >= 0)), 3) AS high_seed_pct, round(count(*) FILTER (grad > 0 AND d < 44) * 1.0::DOUBLE / greatest(1, count(*)), 3) AS edge_only_share,
  round(count(*) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6 AND d > 0) / 24.0::DOUBLE, 3) AS box_coverage FROM g GROUP BY 1""")
def mask_percentages(spark: SparkSession, d: str) -> DataFrame:
    """Shares of seeds and of edges without colour, and how much of a box is set."""
    c = F.col
    box = c("x").between(2, 5) & c("y").between(1, 6)
    return with_gradient(spark, d).groupBy("pair_id").agg(
        F.round(F.count_if(c("d") >= 110) * 100.0 / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("high_seed_pct"), F.round(F.count_if((c("grad") > 0) & (c("d") < 44)) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("edge_only_share"),
        F.round(F.count_if(box & (c("d") > 0)) / 24.0, 3).alias("box_coverage"),
    )


_CLIP = """
o AS (SELECT pair_id, d, row_number() OVER (PARTITION BY pair_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n FROM px),
k AS (SELECT pair_id, d FROM o WHERE i >= floor(n * 0.02::DOUBLE) AND i < greatest(floor(n * 0.02::DOUBLE) + 1, ceil(n * (1 - 0.02::DOUBLE)))),
md AS (SELECT pair_id, median(d)::DOUBLE AS med FROM k GROUP BY 1)"""


@query("clipped_stats", WITH + "," + _CLIP + " SELECT pair_id, any_value(med) AS median, round(greatest(1.0::DOUBLE, median(abs(d - med))::DOUBLE * 1.4826::DOUBLE), 6) AS mad FROM k JOIN md USING (pair_id) GROUP BY 1")
def clipped_stats(spark: SparkSession, d: str) -> DataFrame:
    """Median and MAD without two percent at either end, of a pair's sorted array: no row for a pixel."""
    rows, n = frames(spark, d).select("pair_id", F.sort_array("d").alias("s")), F.size("s")
    low = F.floor(n * 0.02).cast("int")
    high = F.greatest(low + 1, F.ceil(n * (1 - 0.02)).cast("int"))
    rows = spread(rows.select("pair_id", F.slice("s", low + 1, high - low).alias("s")), "s")
    return rows.select("pair_id", "median", F.round(F.greatest(F.lit(1.0), F.col("mad") * 1.4826), 6).alias("mad"))


@query("analysis_regions", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 1 + o_orderkey % 3 WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS n, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey WHEN o_orderkey % 4 = 2 THEN -o_custkey END AS first FROM orders""")
def analysis_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of an analysis: the list, or else the single one of older results, or none."""
    k = F.col("o_orderkey")
    rows = T.read(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 < 2, F.expr("array_repeat(o_custkey, cast(1 + o_orderkey % 3 as int))")).when(k % 4 == 2, F.array().cast("array<long>")).alias("regions"), F.when(k % 4 == 2, -F.col("o_custkey")).alias("region")
    )
    some = F.when(F.coalesce(F.size("regions"), F.lit(0)) > 0, F.col("regions")).when(F.col("region").isNotNull(), F.array("region")).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("r", some).select("id", F.size("r").cast("long").alias("n"), F.try_element_at("r", F.lit(1)).alias("first"))


@query("evidence_sources", """
SELECT page_id, url IS NOT NULL AND url <> '' AND NOT starts_with(CASE WHEN page_id % 3 = 0 THEN 'data:image/svg+xml;' || url ELSE url END, 'data:image/svg+xml') AS evidence FROM pages""")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """Images that count as evidence: any but drawn placeholders."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:image/svg+xml;"), "url")).otherwise(F.col("url"))
    return T.read(spark, d, "pages").select("page_id", F.coalesce((F.length(url) > 0) & ~url.startswith("data:image/svg+xml"), F.lit(False)).alias("evidence"))


@query("default_month", "SELECT count(*) AS alerts, count(*) FILTER (strftime(o_orderdate, '%Y-%m') = '1996-03') AS this_month FROM orders")
def default_month(spark: SparkSession, d: str, day: str = "1996-03-31") -> DataFrame:
    """Alerts of the month in which day lies; a caller passes the present day."""
    same = F.date_format("detected_at", "yyyy-MM") == F.date_format(F.lit(day).cast("date"), "yyyy-MM")
    return T.alerts(spark, d).agg(F.count(F.lit(1)).alias("alerts"), F.count_if(same).alias("this_month"))
