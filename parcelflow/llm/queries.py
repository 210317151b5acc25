"""Queries of this sub-package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import chat, decontamination, jaccard, maxent, merkle, mixing, prefix_trie, quality, sharding, substring_dedup, token_counts, token_files, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_lm_scores": maxent.op3_lm_scores,
        "op4_urls": urls.op4_urls,
        "op5_token_files": token_files.op5_token_files,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_quality": quality.op7_quality,
        "op8_chat": chat.op8_chat,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_mix": mixing.op10_mix,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_merkle": merkle.op12_merkle,
        "op13_shards": sharding.op13_shards,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring_dedup.OP2_SQL, "op6_jaccard": jaccard.OP6_SQL, "op8_chat": chat.OP8_SQL, "op10_mix": mixing.OP10_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
