"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import chat_format, decontaminate, fingerprints, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_sharding": sharding.query,
        "op2_fingerprint_chat_format": chat_format.query,
        "op3_toxicity_fm": toxicity.query,
        "op4_simhash_decontamination": decontaminate.query,
        "op5_systematic_mixing": mixing.query,
        "op6_patience_line_dedup": line_dedup.query,
        "op7_seed_extend_dedup": substring_dedup.query,
        "op8_lsh_forest_near_dedup": near_dedup.query,
        "op9_multiset_hash": fingerprints.query,
        "op10_hierarchical_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fingerprint_chat_format": chat_format.SQL,
        "op5_systematic_mixing": mixing.SQL,
        "op7_seed_extend_dedup": substring_dedup.SQL,
        "op8_lsh_forest_near_dedup": near_dedup.SQL,
    }
