"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from weft.llm import compression_quality, exact_dedup, near_dedup, packing, pieces, pii, quality_rules, secret_scan, tokens, toxicity

QUERIES = {
    "op1_sentencepiece_nbest": pieces.op1_sentencepiece_nbest,
    "op2_compression_quality": compression_quality.op2_compression_quality,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op9_factorization_toxicity": toxicity.op9_factorization_toxicity,
    "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_setsketch_near_dedup": near_dedup.op5_setsketch_near_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_counts": tokens.op8_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

SQL = {
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
