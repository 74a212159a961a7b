"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from deltascope.llm import byte_bpe, conversation_repair, decontaminate, hard_negatives, html_text, license_scan, line_dedup, ngram_join, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_license_scan": license_scan.query,
    "op4_html_text": html_text.query,
    "op5_ngram_join": ngram_join.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_quality_rules": quality_rules.query,
    "op8_toxicity": toxicity.query,
    "op9_line_dedup": line_dedup.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_token_counts": token_counts.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
