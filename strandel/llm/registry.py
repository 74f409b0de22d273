"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from strandel.llm import exact_dedup, html_extract, language_id, line_dedup, minhash_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan

QUERIES = {
    "op6_mixing": mixing.query,
    "op2_secret_scan": secret_scan.query,
    "op7_line_dedup": line_dedup.query,
    "op4_minhash_dedup": minhash_dedup.query,
    "op8_html_extract": html_extract.query,
    "op9_packing": packing.query,
    "op1_quality_classifier": quality_classifier.query,
    "op10_language_id": language_id.query,
    "op3_quality_rules": quality_rules.query,
    "op5_exact_dedup": exact_dedup.query,
    "base3_quality_counts": quality_rules.base_query,
    "base6_mixing_targets": mixing.target_query,
}
ORACLES = {
    "op2_secret_scan": secret_scan.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "base3_quality_counts": quality_rules.BASE_ORACLE,
    "base6_mixing_targets": mixing.TARGET_ORACLE,
}
