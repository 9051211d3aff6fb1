"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import byte_bpe, fingerprints, line_dedup, lm, merkle, mixing, quality, resampling, simhash, substring_dedup, token_counts, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_quality": quality.op4_quality,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_topk": topk.op8_topk,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_merkle": merkle.op11_merkle,
        "op12_lm": lm.op12_lm,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.query_sql(), "op2_mixing": mixing.query_sql(), "op8_topk": topk.query_sql(), "op11_merkle": merkle.query_sql(), "op13_resampling": resampling.query_sql()}
