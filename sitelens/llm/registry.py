"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import fingerprints, html_text, line_dedup, mixing, near_dedup, packing, perplexity, quality, token_counts, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_quality_rules": perplexity.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_text": html_text.op10_html_text,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
