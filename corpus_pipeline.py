"""The corpus pipeline: documents in, files of token ids out.

Each stage works on all rows its predecessor has written and returns the columns of
documents (the last: what the token files hold). SQL can't express the stages (bounds,
alignments, a tokenizer), so ORACLE_SQL is None and tests hold them against brute force.

Defined cases, of all stages: a null text counts as an empty one; nulls in other columns stay;
repeated rows and rows of one id are told apart; a very long text is one row as any other; an
empty table gives an empty one; more columns, of any type and also of names that a stage uses
itself, are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import decontamination, encoding, jaccard, mixing, quality, store, token_files

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep; without a text they fail the base rules."""
    return quality.keep(spark, docs, store.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 (five words) one: its first row in the order of doc_id.

    Each row is a node of its own, whatever its doc_id is; rows without words are similar to nothing and stay.
    """
    scratch = store.Scratch(spark, "near-duplicates")
    rows = scratch.put(store.packed(docs, F.col("doc_id").cast("long").alias("_key"), F.monotonically_increasing_id().alias("_node")), "rows")
    parts = scratch.put(jaccard.join(spark, rows.select(F.col("_node").alias("doc_id"), "_row.text"), 5, 80, 100, count_links=False).select("doc_id", "component_id"), "parts")
    keyed = parts.join(rows.select("_node", "_key"), F.col("doc_id") == F.col("_node"))
    first = keyed.groupBy("component_id").agg(F.min(F.struct("_key", "_node")).alias("m")).select(F.col("m._node").alias("_first"))
    return rows.join(first, F.col("_node") == F.col("_first"), "left_semi").select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item; without test items all stay."""
    return decontamination.clean(spark, docs, store.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without a word are not taken, rows of one id (or of none) are taken alike."""
    return mixing.apply(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, read back: doc_id, start, n_tokens, ids_crc32; in the order of doc_id (null first), then of their ids' bytes."""
    scratch = store.Scratch(spark, "pipeline-corpus")
    token_files.write(spark, docs, scratch.root, encoding.default_path())
    return token_files.read(spark, scratch.root, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = store.Scratch(spark, "pipeline")
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
