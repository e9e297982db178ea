"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, jaccard_join, language_id, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality_classifier": quality_classifier.op3_quality_classifier,
        "op4_sharding": sharding.op4_sharding,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_language_id": language_id.op9_language_id,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result; the other queries are tested against brute force, round trips or held-out rows."""
    return {
        "op1_suffix_dedup": suffix_dedup.SQL,
        "op7_chat_format": chat_format.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op10_jaccard_join": jaccard_join.SQL,
    }
