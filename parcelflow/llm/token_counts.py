"""Exact length histogram: documents by encoded length, and suffix sums over it.

The histogram has one row for each distinct length. What lies at or beyond a length is a
suffix sum; those give for every context limit the documents that fit, the tokens kept when
longer ones are truncated, and quantiles. Sums run in two levels (blocks of lengths, then
lengths of a block), so no task holds the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import encoding, store

BLOCK = 256


def document_lengths(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text).

    Defined cases: a null text has no tokens; a null doc_id stays null; repeated rows count one by
    one; a very long text is encoded whole; an empty table gives no rows; other columns, also of
    clashing names, are ignored.
    """
    store.ship(spark)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoding.lengths(batches, path), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """For each distinct n_tokens: n_docs, docs_at_least, docs_up_to, tokens_at_least, total_tokens,
    truncated_tokens (of all documents cut at this length) and share_up_to (documents no longer).

    Lengths are counted by document, null lengths are left out; no documents give no rows.
    """
    counts = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = store.Scratch(lengths.sparkSession, "lengths").put(counts, "counts")  # read twice below; encoding is the cost
    hist = counts.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    beyond = Window.partitionBy(F.lit(1)).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_d").over(beyond), F.lit(0)).alias("_docs_beyond"),
        F.coalesce(F.sum("_t").over(beyond), F.lit(0)).alias("_tokens_beyond"),
        F.sum("_d").over(whole).alias("_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    rows = hist.join(blocks, F.col("_block") == F.col("_b")).withColumn("docs_at_least", F.col("_docs_beyond") + F.sum("n_docs").over(inside))
    rows = rows.withColumn("tokens_at_least", F.col("_tokens_beyond") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
    up_to = F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", up_to.alias("docs_up_to"), "tokens_at_least", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        (up_to / F.col("_docs")).alias("share_up_to"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents that fit and tokens kept by truncation, from the histogram alone."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    wanted = [F.struct(F.lit(k).cast("long").alias("context"), F.sum(F.when(n <= k, d).otherwise(0)).alias("docs_fit"), F.sum(F.least(n, F.lit(k)) * d).alias("tokens_kept")) for k in limits]
    return hist.agg(F.array(*wanted).alias("x")).select(F.inline("x"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of documents do not exceed."""
    return hist.where(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return histogram(document_lengths(spark, store.table(spark, sf_dir, "documents"), path or encoding.default_path()))
