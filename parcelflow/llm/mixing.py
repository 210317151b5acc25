"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit number (from the MD5 of its id). A source's target is
cut into whole repeats of the source plus a rest; the rest is filled by the documents
whose number is below the source's threshold. The threshold is found from histograms:
sizes are summed by source and the number's first 12 bits, a running sum shows the bucket
in which the budget ends, and only that bucket is split by the next 12 bits, down to
single numbers. Nothing is sorted but the (source, bucket) sums; thresholds are nested, so
a larger target only adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import store

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
MAX_TIMES = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def number(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal form."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, max_times: int = MAX_TIMES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Of (source, source_size): the target of each source.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating, and share the
    sum of all sizes. A target stops at max_times its source's size; what is above is shared
    anew by weight until none is above: sources are filled in order of max_times*size/weight,
    so the first level at which the next source isn't full is the right one for all others.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_times)
    fill = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_open"))
        .withColumn("_full", (F.col("_cap").cast("double") / F.col("_w")) <= F.col("_level"))
    )
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return ranked.withColumn("_common", level).select(
        "source", "source_size", F.when(F.col("_full") | F.col("_common").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_common")).alias("target")
    )


def thresholds(docs: DataFrame, want: DataFrame, scratch: store.Scratch) -> DataFrame:
    """Of docs (source, size, num) and want (source, whole, rest): from which number on a document isn't taken.

    Each level's state (a row for each source) is written, as the next level reads it twice.

    Of the numbers in a source, the one at which the running size passes rest is taken if that
    comes nearer to rest than leaving it.
    """
    state = want.select("source", F.lit(0).cast("long").alias("_prefix"), F.col("rest").alias("_rest"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = docs if level == 1 else docs.join(state.select(F.col("source").alias("_s"), "_prefix"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("num", shift + BITS) == F.col("_prefix")), "left_semi")
        hist = inside.groupBy("source", F.shiftright("num", shift).alias("_b")).agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("source").orderBy("_b")
        hist = hist.withColumn("_upto", F.sum("_n").over(run))
        joined = state.join(hist.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        fits = F.col("_upto") <= F.col("_rest")
        last = F.lit((1 << BITS) - 1)
        edge, below = F.min(F.when(~fits, F.struct("_b", "_upto"))), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0))
        found = joined.groupBy("source", "_prefix", "_rest").agg(edge.alias("_edge"), below.alias("_below"))
        end = F.shiftleft("_prefix", BITS) + last
        if level == LEVELS:
            nearer = (F.col("_edge._upto") - F.col("_rest")) < (F.col("_rest") - F.col("_below"))
            threshold = F.coalesce(F.col("_edge._b") + nearer.cast("long"), end + 1)
        else:
            threshold = F.coalesce("_edge._b", end)
        state = scratch.put(found.select("source", threshold.alias("_prefix"), (F.col("_rest") - F.col("_below")).alias("_rest")), f"level-{level}")
    return state.select("source", F.col("_prefix").alias("threshold"))


def plan(spark: SparkSession, docs: DataFrame, max_times: int = MAX_TIMES, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, source, text): slim (doc_id, source, size, num), and for each source (_s) source_size, target, whole, threshold."""
    scratch = store.Scratch(spark, "mixing")
    slim = scratch.put(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), number(F.col("doc_id")).alias("num")), "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    want = targets(sizes, max_times, weights)
    want = want.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    want = scratch.put(want.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).coalesce(1), "want")
    edge = thresholds(slim, want, scratch).withColumnRenamed("source", "_e")
    told = want.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left").select(F.col("source").alias("_s"), "source_size", "target", "whole", "threshold")
    return slim, scratch.put(told.coalesce(1), "plan")


def _copies(size: Column, num: Column) -> Column:
    return F.when(size > 0, F.col("whole") + (num < F.col("threshold")).cast("long")).otherwise(F.lit(0)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, max_times: int = MAX_TIMES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (= copies * size) for each row of docs (doc_id, source, text).

    Defined cases: a null text has size 0 and isn't taken; a null source is a source of its own;
    rows of equal id (or of a null one) have one number and are taken or left together; an
    empty table gives no rows; other columns of docs are ignored.
    """
    slim, told = plan(spark, docs, max_times, weights)
    out = slim.join(told, F.col("source").eqNullSafe(F.col("_s")), "left").select("doc_id", "size", "source_size", "target", _copies(F.col("size"), F.col("num")).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply(spark: SparkSession, docs: DataFrame, max_times: int = MAX_TIMES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; cases as in mix()."""
    _, told = plan(spark, docs, max_times, weights)
    rows = store.packed(docs, F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), number(F.col("doc_id")).alias("_num"))
    rows = rows.join(told, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("_copies", _copies(F.col("_size"), F.col("_num")))
    return rows.where("_copies > 0").select("_row", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, store.table(spark, sf_dir, "documents")).drop("copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS num
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS opn
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, lft::DOUBLE / opn AS lvl, cap::DOUBLE / w <= lft::DOUBLE / opn AS isfull FROM f),
k AS (SELECT max(lvl) AS common FROM g WHERE NOT isfull),
t AS (SELECT source, source_size, CASE WHEN isfull OR common IS NULL THEN cap::DOUBLE ELSE w * common END AS target FROM g CROSS JOIN k),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.num) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.num) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
