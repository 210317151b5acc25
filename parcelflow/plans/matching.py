"""Matching of descriptors and the transform that matches vote for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.operators import hamming, homography
from parcelflow.plans.registry import query
from parcelflow.sources import tables as T
from parcelflow.sources.scratch import Scratch

# A match's most differing bits (72 of 256, exclusive, here of 64), the ratio of nearest to second, matches kept, pixels of an inlier.
MOST, RATIO, KEPT, RADIUS = 17, 0.74, 700, 3.0


def _pairs(most: int) -> str:
    """Common table expressions: m has each even vector's two nearest odd ones and their distances, of all pairs."""
    return f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
o AS (SELECT a.vec_id AS q, b.vec_id AS t, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS far FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY far, t) AS r FROM o),
m AS (SELECT a.q AS vec_id, a.t AS best, a.far AS first_distance, b.t AS second, b.far AS second_distance FROM r a LEFT JOIN r b ON b.q = a.q AND b.r = 2 AND b.far <= floor({most} / {RATIO}::DOUBLE) WHERE a.r = 1 AND a.far <= {most})"""


def matched(spark: SparkSession, d: str, most: int) -> DataFrame:
    """Vectors of even ids, the later image's descriptors, matched with those of odd ids by the signs of their numbers."""
    rows = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.matches(Scratch(spark, "matches"), rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), [], most, RATIO).withColumnRenamed("id", "vec_id")


@query("descriptor_matches", f"WITH {_pairs(MOST)} SELECT *, second_distance IS NULL OR first_distance < {RATIO}::DOUBLE * second_distance AS \"distinct\" FROM m")
def descriptor_matches(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours by Hamming distance with the ratio test."""
    return matched(spark, d, MOST)


@query("closest_matches", f"WITH {_pairs(22)} SELECT vec_id, best, first_distance AS distance, r AS place FROM (SELECT *, row_number() OVER (ORDER BY first_distance, vec_id) AS r FROM m) WHERE r <= {KEPT}")
def closest_matches(spark: SparkSession, d: str, most: int = KEPT) -> DataFrame:
    """The matches of least distance, so many at most."""
    rows = matched(spark, d, 22).select("vec_id", "best", F.col("first_distance").alias("distance")).orderBy("distance", "vec_id").limit(most)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("distance", "vec_id")))  # most rows


def _points(n) -> str:
    """Source and target of each corner (x, y) under the pair's transform; n writes a number of type double."""
    w = f"(1 + {n('0.0001')} * x)"
    tx = f"({n('1.02')} * x - {n('0.03')} * y + 5 + pair_id % 7) / {w} + noise"
    ty = f"({n('0.04')} * x + {n('0.97')} * y - 3) / {w} - noise + CASE WHEN proposal_id % 5 = 0 THEN 80 ELSE 0 END"
    return f"x AS sx, y AS sy, {tx} AS tx, {ty} AS ty"


def _vote_sql() -> str:
    def double(e: str) -> str:
        return e.replace("1.0", "1.0::DOUBLE")

    nested = "SELECT pair_id, sample, " + ", ".join(f"{a}.{s}{c} AS {s}{c}{k}" for s in "st" for c in "xy" for k, a in ((1, "a"), (2, "b"), (3, "c"), (4, "e"))) + " FROM sm JOIN k a ON a.place = p[1] " + " ".join(f"JOIN k {n} USING (pair_id)" for n in "bce") + " WHERE b.place = p[2] AND c.place = p[3] AND e.place = p[4]"
    for step in homography.steps("s", "t"):
        nested = "SELECT *, " + ", ".join(f"{double(e)} AS {n}" for n, e in step.items()) + f" FROM ({nested})"
    table = ", ".join(f"({k}, {list(s)})" for k, s in enumerate(homography.samples()))
    w = "(h6 * sx + h7 * sy + h8)"
    px, py = f"(h0 * sx + h1 * sy + h2) / {w}", f"(h3 * sx + h4 * sy + h5) / {w}"
    return f"""WITH {T.SQL},
f AS (SELECT pair_id, proposal_id, "left"::DOUBLE AS x, top::DOUBLE AS y, (proposal_id % 3) * 0.4::DOUBLE AS noise, row_number() OVER (PARTITION BY pair_id ORDER BY proposal_id) AS place FROM proposals),
k AS (SELECT pair_id, place, {_points(lambda x: x + "::DOUBLE")} FROM f),
sm AS (SELECT * FROM (VALUES {table}) AS q(sample, p)),
h AS (SELECT pair_id, sample, {", ".join(f"h{i}" for i in range(9))} FROM ({nested}) WHERE flat > {homography.FLAT}),
e AS (SELECT h.pair_id, sample, CASE WHEN {w} <> 0 THEN sqrt(({px} - tx) * ({px} - tx) + ({py} - ty) * ({py} - ty)) END AS err FROM h JOIN k USING (pair_id)),
s AS (SELECT pair_id, sample, count(*) FILTER (err < {RADIUS}) AS inliers, count(*) AS matches, median(err) FILTER (err < {RADIUS}) AS me, quantile_cont(err, 0.95) FILTER (err < {RADIUS}) AS pe FROM e GROUP BY 1, 2)
SELECT pair_id, matches, inliers, round(inliers::DOUBLE / matches, 6) AS inlier_ratio, round(me, 4) AS median_error, round(pe, 4) AS p95_error FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, sample) = 1"""


@query("homography_votes", _vote_sql())
def homography_votes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes' corners matched with their images under a transform of the pair, some of them wrong: inliers and errors of the transform voted for."""
    p = T.proposals(spark, d).select("pair_id", "proposal_id", F.col("left").cast("double").alias("x"), F.col("top").cast("double").alias("y"), ((F.col("proposal_id") % 3) * F.lit(0.4)).alias("noise"))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("proposal_id")))
    rows = homography.vote(Scratch(spark, "votes"), p.selectExpr("pair_id", "place", *_points(lambda x: x + "D").split(", ")), ["pair_id"], RADIUS)
    ratio = F.round(F.col("inliers") / F.col("matches"), 6)
    return rows.select("pair_id", "matches", "inliers", ratio.alias("inlier_ratio"), F.round("median_error", 4).alias("median_error"), F.round("p95_error", 4).alias("p95_error"))
