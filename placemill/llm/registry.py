"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from placemill.llm import exact_dedup, importance, jaccard_join, language_id, line_dedup, merkle, mixing, packing, page_text, quality, substring_dedup, token_count, vector_dedup

QUERIES = {
    "op1_evidence_fusion": language_id,
    "op2_decision_list": quality,
    "op3_weighted_fair_queueing": mixing,
    "op4_page_differencing": page_text,
    "op5_whole_token_shortcut": token_count,
    "op6_suffix_array_runs": line_dedup,
    "op7_best_two_fit": packing,
    "op8_exact_dedup": exact_dedup,
    "op9_adaptive_prefix_join": jaccard_join,
    "op10_fingerprint_index": substring_dedup,
    "op11_merkle_manifest": merkle,
    "op12_inverted_multi_index": vector_dedup,
    "op13_importance_resampling": importance,
}


def queries() -> dict:
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in QUERIES.items() if module.SQL}
