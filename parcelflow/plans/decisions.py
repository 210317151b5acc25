"""Rules over change candidates: factors, score, gates, states, transitions, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.plans.registry import query
from parcelflow.sources import tables as T

# The weights of the nine factors; they sum to 1.
WEIGHTS = {"strength": 0.15, "color": 0.13, "structure": 0.16, "contrast": 0.17, "robust_z": 0.12, "stability": 0.10, "alignment": 0.10, "edge_integrity": 0.05, "shape": 0.02}
# Gates in their order.
GATES = ("AREA_TOO_SMALL", "LOCAL_REGISTRATION_RESIDUAL_HIGH", "INVALID_BORDER_CONTACT", "OUTSIDE_VALID_VIEWPORT", "UI_OR_LABEL_ARTIFACT", "NO_COHERENT_SEED_OR_SUPPORT", "INCOHERENT_EDGE_ONLY_NOISE")
INCOMPATIBLE = "PAIR_COMPATIBILITY_FAILED"

_C = """
c AS (
  SELECT l_orderkey AS pair_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS candidate_id, 100 + l_partkey % 900 AS area,
    (l_partkey % 101)::DOUBLE / 100 AS color_support, (l_suppkey % 83)::DOUBLE / 82 AS structural, ((l_partkey + l_suppkey) % 67)::DOUBLE / 66 AS contrast, (l_partkey % 59)::DOUBLE / 8 AS z,
    (l_suppkey % 71)::DOUBLE / 70 AS stability, (l_partkey % 47)::DOUBLE / 46 AS residual, (l_suppkey % 37)::DOUBLE / 36 AS edge_only, (l_partkey % 31)::DOUBLE / 30 AS compactness, (l_suppkey % 29)::DOUBLE / 28 AS density,
    (l_partkey % 23)::DOUBLE / 60 AS border, l_linenumber <> 3 AS in_view, l_partkey % 53 = 0 AS label_like, 0.3 + (l_suppkey % 41)::DOUBLE / 60 AS median, 0.3::DOUBLE AS low, l_returnflag <> 'N' AS seeded,
    ((l_partkey + l_suppkey) % 19)::DOUBLE / 20 AS removal, 150 AS min_area, l_partkey % 2 = 0 AS known_scale, 10 + l_partkey % 90 AS width, 10 + l_suppkey % 50 AS height
  FROM lineitem)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    ratio = lambda x, m, n: (x % m).cast("double") / n
    return T.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), (p * 1000000 + s * 100 + F.col("l_linenumber")).alias("candidate_id"), (100 + p % 900).alias("area"),
        ratio(p, 101, 100).alias("color_support"), ratio(s, 83, 82).alias("structural"), ratio(p + s, 67, 66).alias("contrast"), ratio(p, 59, 8).alias("z"), ratio(s, 71, 70).alias("stability"),
        ratio(p, 47, 46).alias("residual"), ratio(s, 37, 36).alias("edge_only"), ratio(p, 31, 30).alias("compactness"), ratio(s, 29, 28).alias("density"), ratio(p, 23, 60).alias("border"),
        (F.col("l_linenumber") != 3).alias("in_view"), (p % 53 == 0).alias("label_like"), (0.3 + ratio(s, 41, 60)).alias("median"), F.lit(0.3).alias("low"), (F.col("l_returnflag") != "N").alias("seeded"),
        ratio(p + s, 19, 20).alias("removal"), F.lit(150).alias("min_area"), (p % 2 == 0).alias("known_scale"), (10 + p % 90).alias("width"), (10 + s % 50).alias("height"), F.col("median").alias("inside_mean"),
    )


def unit(x: Column) -> Column:
    """Clamped to 0..1; what is no finite number counts as 0."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def factors() -> dict[str, Column]:
    c = F.col
    return {
        "strength": unit((c("median") - c("low")) / F.greatest(F.lit(0.1), 0.82 - c("low"))), "color": unit(c("color_support") / 0.9), "structure": unit((c("structural") - 0.12) / 0.68),
        "contrast": unit((c("contrast") - 0.05) / 0.45), "robust_z": unit((c("z") - 1.25) / 4.75), "stability": unit((c("stability") - 0.25) / 0.65), "alignment": unit(1 - c("residual") / 0.62),
        "edge_integrity": unit(1 - c("edge_only")), "shape": unit(0.35 * c("compactness") + 0.65 * c("density")),
    }


def score() -> Column:
    return reduce(lambda a, b: a + b, [factors()[k] * w for k, w in WEIGHTS.items()])


def limiting() -> Column:
    """The least factor, shape apart; the first on a tie."""
    f = {k: v for k, v in factors().items() if k != "shape"}
    least = F.least(*f.values())
    return F.coalesce(*(F.when(v == least, F.lit(k)) for k, v in f.items()))


def _u(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


_F = _C + f""",
f AS (SELECT *, {_u("(median - low) / greatest(0.1::DOUBLE, 0.82 - low)")} AS f1, {_u("color_support / 0.9")} AS f2, {_u("(structural - 0.12) / 0.68")} AS f3, {_u("(contrast - 0.05) / 0.45")} AS f4,
  {_u("(z - 1.25) / 4.75")} AS f5, {_u("(stability - 0.25) / 0.65")} AS f6, {_u("1 - residual / 0.62")} AS f7, {_u("1 - edge_only")} AS f8, {_u("0.35 * compactness + 0.65 * density")} AS f9 FROM c),
g AS (SELECT *, round(f1 * 0.15 + f2 * 0.13 + f3 * 0.16 + f4 * 0.17 + f5 * 0.12 + f6 * 0.10 + f7 * 0.10 + f8 * 0.05 + f9 * 0.02, 6) AS score FROM f)"""


@query("component_score", "WITH" + _F + """
SELECT candidate_id, pair_id, score, CASE least(f1, f2, f3, f4, f5, f6, f7, f8) WHEN f1 THEN 'strength' WHEN f2 THEN 'color' WHEN f3 THEN 'structure' WHEN f4 THEN 'contrast' WHEN f5 THEN 'robust_z' WHEN f6 THEN 'stability' WHEN f7 THEN 'alignment' ELSE 'edge_integrity' END AS limiting FROM g""")
def component_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of the factors, and the least of them."""
    return candidates(spark, d).select("candidate_id", "pair_id", F.round(score(), 6).alias("score"), limiting().alias("limiting"))


def checks() -> Column:
    c = F.col
    return reduce(lambda a, b: a + b, [x.cast("int") for x in (c("stability") >= 0.5, c("structural") >= 0.2, c("color_support") >= 0.35, c("removal") >= 0.34, c("contrast") >= 0.12, c("z") >= 1.5)])


def reasons() -> Column:
    """Codes of all gates that close, in their order."""
    c = F.col
    closed = (
        c("area") < c("min_area"), c("residual") > 0.72, c("border") > 0.2, ~c("in_view"), c("label_like"), (c("stability") < 0.2) | (checks() < F.when(c("known_scale"), 4).otherwise(5)),
        (c("edge_only") > 0.39) & ((c("structural") < 0.35) | (c("color_support") < 0.5)),
    )
    return F.array_compact(F.array(*(F.when(x, F.lit(g)) for g, x in zip(GATES, closed, strict=True))))


_G = _F + """,
h AS (SELECT *, list_filter([CASE WHEN area < min_area THEN 'AREA_TOO_SMALL' END, CASE WHEN residual > 0.72 THEN 'LOCAL_REGISTRATION_RESIDUAL_HIGH' END, CASE WHEN border > 0.2 THEN 'INVALID_BORDER_CONTACT' END,
  CASE WHEN NOT in_view THEN 'OUTSIDE_VALID_VIEWPORT' END, CASE WHEN label_like THEN 'UI_OR_LABEL_ARTIFACT' END,
  CASE WHEN stability < 0.2 OR (stability >= 0.5)::INT + (structural >= 0.2)::INT + (color_support >= 0.35)::INT + (removal >= 0.34)::INT + (contrast >= 0.12)::INT + (z >= 1.5)::INT < CASE WHEN known_scale THEN 4 ELSE 5 END THEN 'NO_COHERENT_SEED_OR_SUPPORT' END,
  CASE WHEN edge_only > 0.39 AND (structural < 0.35 OR color_support < 0.5) THEN 'INCOHERENT_EDGE_ONLY_NOISE' END], lambda x: x IS NOT NULL) AS reasons FROM g),
s AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'rejected' WHEN seeded AND score >= 0.5 THEN 'accepted' ELSE 'needs_review' END AS state FROM h)"""


def judge(rows: DataFrame, accept: float, compatible: Column | None = None) -> DataFrame:
    """rows of features with score, limiting factor (the first reason, if there is one), reasons and state; compatible: whether the pair is."""
    why = reasons() if compatible is None else F.concat(reasons(), F.when(compatible, F.array().cast("array<string>")).otherwise(F.array(F.lit(INCOMPATIBLE))))
    rows = rows.withColumn("score", F.round(score(), 6)).withColumn("reasons", why).withColumn("limiting", F.coalesce(F.try_element_at("reasons", F.lit(1)), limiting()))
    return rows.withColumn("state", F.when(F.size("reasons") > 0, "rejected").when(F.col("seeded") & (F.col("score") >= accept), "accepted").otherwise("needs_review"))


def judged(spark: SparkSession, d: str, accept: float = 0.5) -> DataFrame:
    return judge(candidates(spark, d), accept)


def pair_state(reliable: Column, compatible: Column, widespread: Column, accepted: Column, review: Column, components: Column, evidence: Column) -> Column:
    """One state for a pair: the first condition that holds. Numbers of accepted, reviewed and all components, and of pixels over a threshold."""
    return (
        F.when(~reliable, "REGISTRATION_UNRELIABLE").when(~compatible, "COMPATIBILITY_FAILURE").when(widespread, "WIDESPREAD_CHANGE_REVIEW")
        .when((accepted > 0) & (review > 0), "CHANGES_DETECTED_WITH_REVIEW").when(accepted > 0, "CHANGES_DETECTED").when(review > 0, "CHANGES_NEED_REVIEW")
        .when(components > 0, "COMPONENTS_REJECTED").when(evidence > 0, "EVIDENCE_BELOW_THRESHOLD").otherwise("NO_DIFFERENCE_EVIDENCE")
    )


@query("candidate_state", "WITH" + _G + "SELECT candidate_id, pair_id, state, array_to_string(reasons, ',') AS reasons FROM s")
def candidate_state(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("candidate_id", "pair_id", "state", F.array_join("reasons", ",").alias("reasons"))


@query("rejection_histogram", "WITH" + _G + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM s) GROUP BY 1")
def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("candidate_ranking", "WITH" + _G + "SELECT pair_id, candidate_id, CASE state WHEN 'accepted' THEN 'R' ELSE 'V' END || row_number() OVER (PARTITION BY pair_id, state ORDER BY score DESC, sqrt(width * height) * (0.45::DOUBLE + density + median) DESC, candidate_id) AS region_id FROM s WHERE state <> 'rejected'")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Region numbers by rank: R for accepted, V for those to review."""
    value = F.sqrt(F.col("width") * F.col("height")) * (0.45 + F.col("density") + F.col("inside_mean"))
    at = F.row_number().over(Window.partitionBy("pair_id", "state").orderBy(F.desc("score"), value.desc(), "candidate_id"))
    rows = judged(spark, d).where("state <> 'rejected'")
    return rows.select("pair_id", "candidate_id", F.concat(F.when(F.col("state") == "accepted", "R").otherwise("V"), at.cast("string")).alias("region_id"))


@query("detection_state", "WITH" + _G + """,
p AS (SELECT pair_id, count(*) AS n, count(*) FILTER (state = 'accepted') AS a, count(*) FILTER (state = 'needs_review') AS v FROM s WHERE density >= 0.7 GROUP BY 1),
o AS (SELECT o_orderkey AS pair_id, o_orderkey % 97 <> 0 AS ok, o_orderkey % 89 <> 0 AS fits, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(v, 0) AS v, o_orderkey % 3 AS px FROM orders LEFT JOIN p ON pair_id = o_orderkey)
SELECT pair_id, CASE WHEN NOT ok THEN 'REGISTRATION_UNRELIABLE' WHEN NOT fits THEN 'COMPATIBILITY_FAILURE' WHEN v >= 3 THEN 'WIDESPREAD_CHANGE_REVIEW' WHEN a > 0 AND v > 0 THEN 'CHANGES_DETECTED_WITH_REVIEW'
  WHEN a > 0 THEN 'CHANGES_DETECTED' WHEN v > 0 THEN 'CHANGES_NEED_REVIEW' WHEN n > 0 THEN 'COMPONENTS_REJECTED' WHEN px > 0 THEN 'EVIDENCE_BELOW_THRESHOLD' ELSE 'NO_DIFFERENCE_EVIDENCE' END AS state FROM o""")
def detection_state(spark: SparkSession, d: str) -> DataFrame:
    """A state for every pair, also for those without a component (here: a dense candidate)."""
    n = lambda s: F.count_if(F.col("state") == s)
    k = F.col("o_orderkey")
    found = judged(spark, d).where("density >= 0.7").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), n("accepted").alias("a"), n("needs_review").alias("v"))
    rows = T.read(spark, d, "orders").select(k).join(found, k == F.col("pair_id"), "left").fillna(0, ["n", "a", "v"])
    state = pair_state(k % 97 != 0, k % 89 != 0, F.col("v") >= 3, F.col("a"), F.col("v"), F.col("n"), k % 3)
    return rows.select(k.alias("pair_id"), state.alias("state"))


@query("semantic_transition", "WITH" + _G + """,
m AS (SELECT pair_id, candidate_id, ['physical_change', 'likely_artifact', 'maybe', 'uncertain'][(area % 4 + 1)::INT] AS decision FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, candidate_id ORDER BY area) AS r FROM c WHERE area % 5 <> 0) WHERE r = 1),
t AS (SELECT s.pair_id, s.candidate_id, s.state AS before, m.decision IS NOT NULL AND s.state <> 'rejected' AS told, m.decision = 'likely_artifact' AND area % 6 > 0 AND score >= 0.5 AND structural >= 0.2 AND contrast >= 0.12 AS strong, m.decision AS d FROM s LEFT JOIN m USING (pair_id, candidate_id)),
u AS (SELECT *, CASE WHEN NOT told THEN before WHEN d = 'physical_change' THEN 'accepted' WHEN strong THEN 'needs_review' WHEN d = 'likely_artifact' THEN 'rejected' ELSE 'needs_review' END AS after FROM t)
SELECT pair_id, candidate_id, before, after, CASE WHEN NOT told THEN NULL WHEN d = 'physical_change' THEN CASE WHEN before <> 'accepted' THEN 'SEMANTIC_PHYSICAL_CHANGE' END WHEN strong THEN 'semantic_pixel_evidence_conflict' WHEN d = 'likely_artifact' THEN 'SEMANTIC_LIKELY_ARTIFACT' WHEN before <> 'needs_review' THEN 'SEMANTIC_UNCERTAIN' END AS reason FROM u""")
def semantic_transition(spark: SparkSession, d: str) -> DataFrame:
    return transitions(spark, d)


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """A second opinion on what isn't rejected; of several on a candidate the first counts."""
    rows = judged(spark, d).withColumn("geometry", F.when(F.col("area") % 6 > 0, "pixel_mask").otherwise("frontier_bbox"))
    said = T.pick(("physical_change", "likely_artifact", "maybe", "uncertain"), F.col("area") % 4)
    first = rows.where("area % 5 <> 0").groupBy("pair_id", "candidate_id").agg(F.min_by(said, "area").alias("decision"))
    return opinion(rows.join(first, ["pair_id", "candidate_id"], "left"), 0.5).select("pair_id", "candidate_id", F.col("state").alias("before"), "after", "reason")


def strong_evidence(accept: float) -> Column:
    """Pixel evidence that a second opinion alone can't dismiss."""
    c = F.col
    return F.coalesce((c("geometry") == "pixel_mask") & (c("score") >= accept) & (c("structural") >= 0.2) & (c("contrast") >= 0.12), F.lit(False))


def opinion(rows: DataFrame, accept: float) -> DataFrame:
    """rows (candidates, geometry, decision or null) with after, the state that follows, and reason of the change (null: none is recorded)."""
    told = F.col("decision").isNotNull() & (F.col("state") != "rejected")
    change, artifact, strong = F.col("decision") == "physical_change", F.col("decision") == "likely_artifact", strong_evidence(accept)
    after = F.when(~told, F.col("state")).when(change, "accepted").when(artifact & ~strong, "rejected").otherwise("needs_review")
    reason = (
        F.when(~told, None).when(change, F.when(F.col("state") != "accepted", "SEMANTIC_PHYSICAL_CHANGE")).when(artifact & strong, "semantic_pixel_evidence_conflict")
        .when(artifact, "SEMANTIC_LIKELY_ARTIFACT").when(F.col("state") != "needs_review", "SEMANTIC_UNCERTAIN")
    )
    return rows.withColumn("after", after).withColumn("reason", reason)


@query("state_masks", "WITH" + _G + "SELECT pair_id, bool_or(state = 'accepted') AS accepted, bool_or(state = 'needs_review') AS review, bool_or(state = 'rejected') AS rejected, count(*) FILTER ((state = 'accepted')::INT + (state = 'needs_review')::INT + (state = 'rejected')::INT <> 1) AS broken FROM s GROUP BY 1")
def state_masks(spark: SparkSession, d: str) -> DataFrame:
    """Which states a pair has; broken counts candidates that aren't in just one."""
    is_ = lambda s: F.col("state") == s
    one = is_("accepted").cast("int") + is_("needs_review").cast("int") + is_("rejected").cast("int")
    return judged(spark, d).groupBy("pair_id").agg(*(F.bool_or(is_(s)).alias(n) for s, n in (("accepted", "accepted"), ("needs_review", "review"), ("rejected", "rejected"))), F.count_if(one != 1).alias("broken"))


@query("mean_severity", "WITH" + _G + "SELECT pair_id, e6 AS confidence_e6, CASE WHEN e6 >= 850000 THEN 'high' WHEN e6 >= 720000 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT pair_id, (sum(round(score * 1000000)::BIGINT) // count(*))::BIGINT AS e6 FROM s WHERE state <> 'rejected' GROUP BY 1)")
def mean_severity(spark: SparkSession, d: str) -> DataFrame:
    """Mean score in millionths (whole numbers, so the sum doesn't depend on its order) and its grade."""
    e6 = F.expr("sum(cast(round(score * 1000000) as long)) div count(1)")
    rows = judged(spark, d).where("state <> 'rejected'").groupBy("pair_id").agg(e6.alias("confidence_e6"))
    return rows.withColumn("severity", F.when(F.col("confidence_e6") >= 850000, "high").when(F.col("confidence_e6") >= 720000, "medium").otherwise("low"))
