"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, language_id, mixing, passage_dedup, simhash_dedup, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_passage_dedup": passage_dedup.query,
    "op4_html_text": html_extract.query,
    "op5_toxicity": toxicity.query,
    "op6_mix_sources": mixing.query,
    "op7_language_id": language_id.query,
    "op8_simhash_dedup": simhash_dedup.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_token_output": token_output.query,
}

SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op6_mix_sources": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
