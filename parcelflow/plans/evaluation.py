"""Evaluation of detected changes against reviewed truth: confusion, recall by bucket, one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import boxes as B
from parcelflow.operators.greedy import first_matching
from parcelflow.plans.registry import query
from parcelflow.plans.raster import WITH, pixels
from parcelflow.sources import tables as T
from parcelflow.sources.scratch import Scratch


@query("pixel_confusion", WITH + """,
c AS (SELECT pair_id, count(*) FILTER (a > 140 AND b > 140) AS tp, count(*) FILTER (NOT a > 140 AND b > 140) AS fp, count(*) FILTER (a > 140 AND NOT b > 140) AS fn FROM px GROUP BY 1)
SELECT pair_id, tp, fp, fn, round(tp::DOUBLE / greatest(1, tp + fp), 3) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 3) AS recall, round(2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn), 3) AS f1, round(tp::DOUBLE / greatest(1, tp + fp + fn), 3) AS iou FROM c""")
def pixel_confusion(spark: SparkSession, d: str) -> DataFrame:
    truth, found = F.col("a") > 140, F.col("b") > 140
    rows = pixels(spark, d).groupBy("pair_id").agg(F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"))
    return rows.withColumns(confusion(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Ratios to three digits; an empty denominator counts as 1."""
    part = lambda x, n: F.round(x / F.greatest(F.lit(1), n), 3)
    return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2.0 * tp, 2 * tp + fp + fn), "iou": part(tp, tp + fp + fn)}


_BOXES = """greatest(0, least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) * greatest(0, least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top))"""


def _matching(name: str, flags: str) -> str:
    """Common table expressions: name_m has each truth that anything covers, and what it is matched with."""
    free = f"list_filter(t.c, lambda x: NOT list_contains(m.taken, x))[1]"  # noqa: F541
    return f"""
{name}_o AS (SELECT a.pair_id, a.proposal_id AS truth_id, b.proposal_id AS found_id, ({_BOXES})::DOUBLE / (a.width * a.height) AS share FROM proposals a JOIN proposals b ON a.pair_id = b.pair_id AND a.flag = 'R' AND b.flag IN {flags}),
{name}_l AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY truth_id) AS r FROM (SELECT pair_id, truth_id, list(found_id ORDER BY share DESC, found_id) AS c FROM {name}_o WHERE share >= 0.01 GROUP BY 1, 2)),
{name}_m AS (SELECT pair_id, r, truth_id, c[1] AS found_id, [c[1]] AS taken FROM {name}_l WHERE r = 1
  UNION ALL SELECT t.pair_id, t.r, t.truth_id, {free}, list_append(m.taken, {free}) FROM {name}_m m JOIN {name}_l t ON t.pair_id = m.pair_id AND t.r = m.r + 1)"""


#: Flag R marks a truth, A an accepted region, N one to review.
ACCEPTED, ALL = ("A",), ("A", "N")
_WITH = f"WITH RECURSIVE {T.SQL}," + _matching("all", "('A', 'N')")
_BOTH = _WITH + "," + _matching("own", "('A')") + """,
t AS (SELECT p.pair_id, p.proposal_id, p.change_type, p.width * p.height * 0.01::DOUBLE AS m2, o.found_id IS NOT NULL AS own, a.found_id IS NOT NULL AS every FROM proposals p
  LEFT JOIN own_m o ON o.pair_id = p.pair_id AND o.truth_id = p.proposal_id LEFT JOIN all_m a ON a.pair_id = p.pair_id AND a.truth_id = p.proposal_id WHERE p.flag = 'R')"""


def matches(p: DataFrame, flags: tuple[str, ...] = ALL) -> DataFrame:
    """pair_id, truth_id, found_id (null: nothing is left for it) of truths that any prediction covers: one to one, truths in the order of ids.

    A truth takes the free prediction that covers most of it, the first of equals.
    """
    scratch = Scratch(p.sparkSession, "matching")
    rows = p.where(F.col("flag").isin("R", *flags)).select("pair_id", "proposal_id", "left", "top", "width", "height", "flag").withColumn("n", F.row_number().over(Window.partitionBy("pair_id").orderBy("proposal_id")))
    met = B.meeting(scratch, rows, "pair_id", "n", lambda a, b: (a["flag"] == "R") & b["flag"].isin(*flags))
    met = met.select("pair_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("proposal_id", "left", "top", "width", "height")))
    rows = met.select("pair_id", F.col("a_proposal_id").alias("left"), F.col("b_proposal_id").alias("right"), (B.overlap("a_", "b_") / B.area("a_")).alias("share")).where("share >= 0.01")
    rank = F.row_number().over(Window.partitionBy("pair_id", "left").orderBy(F.desc("share"), "right"))
    out = first_matching(scratch, rows.withColumn("rank", rank), ["pair_id"])
    return out.select("pair_id", F.col("left").alias("truth_id"), F.col("right").alias("found_id"))


def truths(spark: SparkSession, d: str) -> DataFrame:
    """Truths with their area and whether accepted regions (own), or those to review as well (every), find them."""
    p = T.proposals(spark, d)
    hit = lambda flags, name: matches(p, flags).where("found_id is not null").select("pair_id", F.col("truth_id").alias("proposal_id"), F.lit(True).alias(name))
    rows = p.where("flag = 'R'").join(hit(ACCEPTED, "own"), ["pair_id", "proposal_id"], "left").join(hit(ALL, "every"), ["pair_id", "proposal_id"], "left").fillna(False, ["own", "every"])
    return rows.withColumn("m2", F.col("width") * F.col("height") * 0.01)


def recall(rows: DataFrame, by: Column) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share("own").alias("accepted_recall"), share("every").alias("recall"))


# Names of the size buckets.
def _bucket(m2: Column) -> Column:
    return F.when(m2.isNull(), "unknown_scale").when(m2 < 20, "under_20_m2").when(m2 <= 50, "20_to_50_m2").when(m2 <= 200, "50_to_200_m2").otherwise("over_200_m2")


@query("size_recall", _BOTH + """
SELECT CASE WHEN m2 < 20 THEN 'under_20_m2' WHEN m2 <= 50 THEN '20_to_50_m2' WHEN m2 <= 200 THEN '50_to_200_m2' ELSE 'over_200_m2' END AS bucket, count(*) AS n, round(avg(own::INT), 3) AS accepted_recall, round(avg(every::INT), 3) AS recall FROM t GROUP BY 1""")
def size_recall(spark: SparkSession, d: str) -> DataFrame:
    return recall(truths(spark, d), _bucket(F.col("m2")).alias("bucket"))


@query("class_recall", _BOTH + " SELECT change_type, count(*) AS n, round(avg(own::INT), 3) AS accepted_recall, round(avg(every::INT), 3) AS recall FROM t GROUP BY 1")
def class_recall(spark: SparkSession, d: str) -> DataFrame:
    return recall(truths(spark, d), F.col("change_type"))


@query("object_matching", _WITH + " SELECT pair_id, truth_id, found_id FROM all_m")
def object_matching(spark: SparkSession, d: str) -> DataFrame:
    return matches(T.proposals(spark, d))


@query("missed_objects", _WITH + """
SELECT p.pair_id, p.proposal_id AS truth_id FROM proposals p WHERE p.flag = 'R' AND NOT EXISTS (SELECT 1 FROM all_m m WHERE m.pair_id = p.pair_id AND m.truth_id = p.proposal_id AND m.found_id IS NOT NULL)""")
def missed_objects(spark: SparkSession, d: str) -> DataFrame:
    """Truths that the one-to-one matching leaves without a prediction."""
    p = T.proposals(spark, d)
    hit = matches(p).where("found_id is not null").select("pair_id", "truth_id")
    return p.where("flag = 'R'").select("pair_id", F.col("proposal_id").alias("truth_id")).join(hit, ["pair_id", "truth_id"], "left_anti")


def metrics(tp: Column, fp: Column, fn: Column, negatives: Column) -> dict[str, Column]:
    """Pixel ratios to three digits; what needs reviewed negatives is null without them."""
    precision, found = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    f1 = 2 * precision * found / F.greatest(F.lit(2.220446049250313e-16), precision + found)
    return {
        "precision": F.when(negatives, F.round(precision, 3)), "recall": F.round(found, 3), "f1": F.when(negatives, F.round(f1, 3)), "iou": F.round(tp / F.greatest(F.lit(1), tp + fp + fn), 3),
        "precision_status": F.when(negatives, "available").otherwise("unavailable_no_reviewed_negative_regions"),
    }


@query("benchmark_pixels", WITH + """,
ev AS (SELECT *, a > 140 AS truth, b > 140 AS found, a > 140 OR (pair_id % 3 <> 0 AND x < 4) AS seen FROM px),
c AS (SELECT pair_id, pair_id % 3 <> 0 AS neg, count(*) FILTER (seen) AS reviewed, count(*) FILTER (NOT seen) AS ignored, (count(*) FILTER (seen AND truth AND found))::DOUBLE AS tp, (count(*) FILTER (seen AND NOT truth AND found))::DOUBLE AS fp, (count(*) FILTER (seen AND truth AND NOT found))::DOUBLE AS fn FROM ev GROUP BY 1),
ra AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM c)
SELECT pair_id, reviewed, ignored, CASE WHEN neg THEN round(pr, 3) END AS precision, round(re, 3) AS recall, CASE WHEN neg THEN round(2 * pr * re / greatest(2.220446049250313e-16::DOUBLE, pr + re), 3) END AS f1, round(tp / greatest(1, tp + fp + fn), 3) AS iou,
  CASE WHEN neg THEN 'available' ELSE 'unavailable_no_reviewed_negative_regions' END AS precision_status FROM ra""")
def benchmark_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Confusion inside the reviewed area only: truths and reviewed negatives (here: the left half of two pairs in three)."""
    truth, found, seen = F.col("a") > 140, F.col("b") > 140, (F.col("a") > 140) | ((F.col("pair_id") % 3 != 0) & (F.col("x") < 4))
    n = lambda c: F.count_if(c).cast("double")
    rows = pixels(spark, d).groupBy("pair_id").agg(F.count_if(seen).alias("reviewed"), F.count_if(~seen).alias("ignored"), n(seen & truth & found).alias("tp"), n(seen & ~truth & found).alias("fp"), n(seen & truth & ~found).alias("fn"))
    return rows.withColumns(metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("pair_id") % 3 != 0)).drop("tp", "fp", "fn")


_NEAR = """(pair_id % 3 <> 0 AND "left" < 200 AND top < 200)"""


def _objects(name: str, flags: str) -> str:
    return f"""
{name}_a AS (SELECT DISTINCT b.pair_id, b.proposal_id FROM proposals b LEFT JOIN proposals a ON a.pair_id = b.pair_id AND a.flag = 'R' AND {_BOXES} > 0 WHERE b.flag IN {flags} AND (a.pair_id IS NOT NULL OR (b.pair_id % 3 <> 0 AND b."left" < 200 AND b.top < 200))),
{name}_c AS (SELECT pair_id, count(*) AS n FROM {name}_a GROUP BY 1), {name}_k AS (SELECT pair_id, count(found_id) AS n FROM {name}_m GROUP BY 1)"""


@query("benchmark_report", _BOTH + "," + _objects("all", "('A', 'N')") + "," + _objects("own", "('A')") + """,
g AS (SELECT pair_id, count(*) AS truths, sum(m2) AS area FROM t GROUP BY 1),
r AS (SELECT g.*, pair_id % 3 <> 0 AS neg, coalesce(ok.n, 0) AS om, greatest(0, coalesce(oc.n, 0) - coalesce(ok.n, 0)) AS ofa, coalesce(ak.n, 0) AS am, greatest(0, coalesce(ac.n, 0) - coalesce(ak.n, 0)) AS afa
  FROM g LEFT JOIN own_c oc USING (pair_id) LEFT JOIN own_k ok USING (pair_id) LEFT JOIN all_c ac USING (pair_id) LEFT JOIN all_k ak USING (pair_id))
SELECT pair_id, truths, round(om::DOUBLE / greatest(1, truths), 3) AS accepted_recall, truths - om AS accepted_missed, CASE WHEN neg THEN round(om::DOUBLE / greatest(1, om + ofa), 3) END AS accepted_precision, CASE WHEN neg THEN ofa END AS accepted_false_alarms,
  round(am::DOUBLE / greatest(1, truths), 3) AS recall, truths - am AS missed, CASE WHEN neg THEN round(am::DOUBLE / greatest(1, am + afa), 3) END AS precision, CASE WHEN neg THEN afa END AS false_alarms,
  CASE WHEN neg THEN round(afa / (area / 1000000), 1) END AS false_alarms_km2, CASE WHEN neg THEN 'available' ELSE 'unavailable_no_reviewed_negative_regions' END AS precision_status FROM r""")
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """Objects found by accepted regions alone and with those to review, a row for each pair with a truth.

    A false alarm is a prediction in the reviewed area (a truth's box, or a reviewed negative one: here a corner of two pairs in three) beyond those matched.
    """
    p = T.proposals(spark, d)
    rows = truths(spark, d).groupBy("pair_id").agg(F.count(F.lit(1)).alias("truths"), F.sum("m2").alias("area"), F.count_if("own").alias("om"), F.count_if("every").alias("am"))
    side = lambda x, s: x.select("pair_id", *(F.col(c).alias(f"{s}_{c}") for c in ("proposal_id", "left", "top", "width", "height")))
    a = side(p.where("flag = 'R'"), "a").withColumnRenamed("pair_id", "_pair")
    corner = (F.col("pair_id") % 3 != 0) & (F.col("b_left") < 200) & (F.col("b_top") < 200)
    for flags, name in ((ACCEPTED, "o"), (ALL, "a")):
        b = side(p.where(F.col("flag").isin(*flags)), "b")
        near = b.join(a, (F.col("pair_id") == F.col("_pair")) & (B.overlap("a_", "b_") > 0), "left_semi").unionByName(b.where(corner)).select("pair_id", "b_proposal_id").distinct()
        rows = rows.join(near.groupBy("pair_id").agg(F.count(F.lit(1)).alias(f"{name}_near")), "pair_id", "left")
        rows = rows.withColumn(f"{name}fa", F.greatest(F.lit(0), F.coalesce(f"{name}_near", F.lit(0)) - F.col(f"{name}m")))
    neg = F.col("pair_id") % 3 != 0
    part = lambda x, n: F.round(F.col(x).cast("double") / F.greatest(F.lit(1), n), 3)
    return rows.select(
        "pair_id", "truths", part("om", F.col("truths")).alias("accepted_recall"), (F.col("truths") - F.col("om")).alias("accepted_missed"), F.when(neg, part("om", F.col("om") + F.col("ofa"))).alias("accepted_precision"),
        F.when(neg, F.col("ofa")).alias("accepted_false_alarms"), part("am", F.col("truths")).alias("recall"), (F.col("truths") - F.col("am")).alias("missed"), F.when(neg, part("am", F.col("am") + F.col("afa"))).alias("precision"),
        F.when(neg, F.col("afa")).alias("false_alarms"), F.when(neg, F.round(F.col("afa") / (F.col("area") / 1000000), 1)).alias("false_alarms_km2"),
        F.when(neg, "available").otherwise("unavailable_no_reviewed_negative_regions").alias("precision_status"),
    )


@query("annotation_validation", """
WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '0.9' WHEN o_orderkey % 11 = 0 THEN NULL ELSE '1.0' END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'negative' ELSE 'ignore' END AS policy,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS geography, o_orderstatus AS date_group, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 'p' END AS provider FROM orders)
SELECT id, CASE WHEN version IS DISTINCT FROM '1.0' THEN 'UNSUPPORTED_SCHEMA' WHEN policy IS DISTINCT FROM 'ignore' THEN 'UNREVIEWED_MUST_BE_IGNORED' WHEN coalesce(geography, '') = '' OR coalesce(date_group, '') = '' OR coalesce(provider, '') = '' THEN 'SPLIT_GROUPS_REQUIRED' END AS refused FROM a""")
def annotation_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = T.read(spark, d, "orders").select(
        k.alias("id"), F.when(k % 7 == 0, "0.9").when(k % 11 == 0, None).otherwise("1.0").alias("schemaVersion"), F.when(k % 5 == 0, "negative").otherwise("ignore").alias("unreviewedPolicy"),
        F.struct(F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("geographyGroup"), F.col("o_orderstatus").alias("dateGroup"), F.when(F.col("o_custkey") % 13 != 0, "p").alias("providerGroup")).alias("split"),
    )
    return rows.select("id", refused().alias("refused"))


def refused() -> Column:
    """Why an annotation can't be used (null: it can): another schema, unreviewed areas that count, or a split without its groups."""
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return (
        F.when(~F.col("schemaVersion").eqNullSafe(F.lit("1.0")), "UNSUPPORTED_SCHEMA").when(~F.col("unreviewedPolicy").eqNullSafe(F.lit("ignore")), "UNREVIEWED_MUST_BE_IGNORED")
        .when(empty("split.geographyGroup") | empty("split.dateGroup") | empty("split.providerGroup"), "SPLIT_GROUPS_REQUIRED")
    )
