"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from syncsift.llm import byte_bpe, conversations, divergence, exact_dedup, exact_topk, hilbert_ann, licenses, line_dedup, packing, quality, simhash, suffix_dedup, toxicity


def _on(table: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _labelled(classify: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _on("documents", licenses.digest),
        "op2_hilbert_ann": _on("embeddings", hilbert_ann.digest),
        "op3_suffix_dedup": _on("documents", suffix_dedup.digest),
        "op4_exact_topk": _on("embeddings", exact_topk.digest),
        "op5_quality_classifier": _labelled(quality.classify),
        "op6_packing": _on("documents", packing.pack),
        "op7_byte_bpe": _on("documents", byte_bpe.digest),
        "op8_line_dedup": _on("documents", line_dedup.digest),
        "op9_toxicity": _labelled(toxicity.classify),
        "op10_simhash_near_dedup": _on("documents", simhash.digest),
        "op11_exact_dedup": _on("documents", exact_dedup.digest),
        "op12_conversation_repair": _on("conversations", conversations.digest),
        "op13_source_divergence": _on("documents", divergence.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": suffix_dedup.ORACLE, "op4_exact_topk": exact_topk.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_exact_dedup": exact_dedup.ORACLE, "op12_conversation_repair": conversations.ORACLE, "op13_source_divergence": divergence.ORACLE}
