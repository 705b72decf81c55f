"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilworks.llm import decontaminate, encoding, hardneg, language, maxscore, mixing, neardup, quality, secrets, sharding, substrings, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_maxscore": maxscore.query,
        "op2_language_ecoc": language.query,
        "op3_quality_rules": quality.query,
        "op4_suffix_dedup": substrings.query,
        "op5_secret_scan": secrets.query,
        "op6_maxplus_encode": encoding.query,
        "op7_compression_toxicity": toxicity.query,
        "op8_virtual_slots": sharding.query,
        "op9_pareto_mix": mixing.query,
        "op10_bottom_k": neardup.query,
        "op11_wu_manber": decontaminate.query,
        "op12_cover_tree_negatives": hardneg.query,
        "op13_jacobi_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_maxscore": maxscore.ORACLE_SQL,
        "op3_quality_rules": quality.ORACLE_SQL,
        "op9_pareto_mix": mixing.ORACLE_SQL,
        "op10_bottom_k": neardup.ORACLE_SQL,
        "op11_wu_manber": decontaminate.ORACLE_SQL,
        "op12_cover_tree_negatives": hardneg.ORACLE_SQL,
    }
