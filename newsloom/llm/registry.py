"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    chat_format,
    embedding_whitening,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    license_scan,
    merkle_manifest,
    secret_scan,
    sentencepiece_codec,
    sharding,
    source_mixing,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op3_link_counts": jaccard_join.op3_link_counts,
        "op4_sharding": sharding.op4_sharding,
        "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
        "op6_source_mixing": source_mixing.op6_source_mixing,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_language_id": language_id.op9_language_id,
        "op10_chat_format": chat_format.op10_chat_format,
        "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
        "op12_embedding_whitening": embedding_whitening.op12_embedding_whitening,
        "op13_secret_scan": secret_scan.op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.OP1_SQL,
        "op2_license_scan": license_scan.OP2_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op6_source_mixing": source_mixing.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op11_merkle_manifest": merkle_manifest.OP11_SQL,
    }
