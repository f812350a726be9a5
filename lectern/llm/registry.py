"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, licences, linededup, lm, media, neardup, packing, quality, resampling, tokencounts, topk, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_license_scan": licences.op2_license_scan,
        "op3_token_counts": tokencounts.op3_token_counts,
        "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
        "op5_language_id": langid.op5_language_id,
        "op6_lm_scoring": lm.op6_lm_scoring,
        "op7_line_dedup": linededup.op7_line_dedup,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_media_columns": media.op9_media_columns,
        "op10_packing": packing.op10_packing,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_exact_topk": topk.op12_exact_topk,
        "op13_importance_resampling": resampling.op13_importance_resampling,
        "op2_license_tree": licences.op2_license_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licences.SQL,
        "op2_license_tree": licences.TREE_SQL,
        "op7_line_dedup": linededup.SQL,
        "op8_quality_rules": quality.SQL,
        "op12_exact_topk": topk.SQL,
        "op13_importance_resampling": resampling.SQL,
    }
