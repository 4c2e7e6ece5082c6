"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_extraction, importance_resampling, jaccard_join, language_id, license_scan, lm_scoring, mixing, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_html_extraction": html_extraction.op5_html_extraction,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_mixing": mixing.op9_mixing,
        "op10_importance_resampling": importance_resampling.op10_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_decontamination": decontamination.OP3_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op9_mixing": mixing.OP9_SQL,
    }
