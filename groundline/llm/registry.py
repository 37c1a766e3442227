"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from groundline.llm import chunk_bpe, exact_dedup, hilbert, jaccard_join, language_id, packing, suffix_dedup, token_counts, toxicity, winnowing


def queries() -> dict:
    return {
        "op1_winnowing": winnowing.op1_winnowing,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language_id": language_id.op4_language_id,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_hilbert_sharding": hilbert.op7_hilbert_sharding,
        "op8_chunk_bpe": chunk_bpe.op8_chunk_bpe,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict:
    return {"op9_exact_dedup": exact_dedup.OP9_SQL}
