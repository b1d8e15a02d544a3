"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from lectern.llm import fingerprints, langid, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_near_dedup": near_dedup.query,
        "op3_quality_classifier": quality_classifier.query,
        "op4_toxicity": toxicity.query,
        "op5_url_filter": url_filter.query,
        "op6_fingerprints": fingerprints.query,
        "op7_quality_rules": quality_rules.query,
        "op8_packing": packing.query,
        "op9_language_id": langid.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE,
        "op2_near_dedup": near_dedup.ORACLE,
        "op5_url_filter": url_filter.ORACLE,
        "op6_fingerprints": fingerprints.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
    }
