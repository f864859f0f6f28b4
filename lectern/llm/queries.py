"""The queries of this package, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, erasure, html_text, line_dedup, mixing, near_dup, quality_model, quality_rules, ring, substring_dedup, token_counts, token_files, vector_codes

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_robust_outliers": quality_rules.query,
    "op3_ring_sharding": ring.query,
    "op4_decontamination": decontaminate.query,
    "op5_bottom_k_near_dup": near_dup.query,
    "op6_line_chunks": line_dedup.query,
    "op7_token_counts": token_counts.query,
    "op8_site_quality": quality_model.query,
    "op9_token_files": token_files.query,
    "op10_main_text": html_text.query,
    "op11_suffix_dedup": substring_dedup.query,
    "op12_vector_codes": vector_codes.query,
    "op13_cascading_erasure": erasure.query,
}

ORACLE_SQL = {
    "op1_source_mixing": mixing.SQL,
    "op3_ring_sharding": ring.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op5_bottom_k_near_dup": near_dup.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
