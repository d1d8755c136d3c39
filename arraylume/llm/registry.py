"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from arraylume.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules, secrets, sharding, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_benchmark_decontamination": decontamination.query,
    "op2_quality_rules": quality_rules.query,
    "op3_token_counts": token_counts.query,
    "op4_secret_scans": secrets.query,
    "op5_sharding": sharding.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_url_filters": url_filter.query,
    "op10_packing": packing.query,
}

ORACLE = {
    "op1_benchmark_decontamination": decontamination.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_url_filters": url_filter.SQL,
}
