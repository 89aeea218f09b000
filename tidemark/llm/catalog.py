"""Queries of this subpackage and the SQL that states the same results, where SQL can."""

from __future__ import annotations

from tidemark.llm import bpe, decontaminate, html_text, language_id, quality_knn, quality_rules, sharding, simhash, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_html_text": html_text.op5_html_text,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_language_id": language_id.op8_language_id,
        "op9_quality_knn": quality_knn.op9_quality_knn,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.SQL, "op7_url_filters": url_filters.SQL}
