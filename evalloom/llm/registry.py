"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from evalloom.llm import embedding_dedup, exact_dedup, hard_negatives, importance, jaccard_join, language, licenses, mixing, packing, quality, substring_dedup, token_ids, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_packing": packing.op5_packing,
    "packed_conversations": packing.packed_conversations,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licenses": licenses.op8_licenses,
    "op8_license_windows": licenses.op8_license_windows,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language": language.op10_language,
    "op11_quality": quality.op11_quality,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_importance": importance.op13_importance,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_importance": importance.OP13_SQL,
}
