"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemark.llm import decontamination, license_scan, line_dedup, mixing, ngram_join, quality_fm, quality_rules, substring_dedup, token_count, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op3_url_filters": url_filter.op3_url_filters,
    "url_filters_planted": url_filter.url_filters_planted,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_fm.op5_quality_classifier,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_license_scans": license_scan.op9_license_scans,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_url_filters": url_filter.OP3_SQL,
    "url_filters_planted": url_filter.PLANTED_SQL,
    "op7_ngram_jaccard": ngram_join.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
