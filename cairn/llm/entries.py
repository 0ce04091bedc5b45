"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from cairn.llm import chat_format, decontaminate, license_scan, line_dedup, lm_score, near_dup, packing, quality, toxicity, url_filter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_simhash_near_dup": near_dup.op5_simhash_near_dup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_lm_score": lm_score.op10_lm_score,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL_OP1,
        "op2_license_scan": license_scan.sql_op2(),
        "op6_chat_format": chat_format.SQL_OP6,
        "op7_line_dedup": line_dedup.SQL_OP7,
        "op8_url_filter": url_filter.sql_op8(),
    }
