"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, decontaminate, language_id, language_model, merkle, near_dedup, pieces, quality, substring_dedup, suffix_array, token_count, topk, toxicity

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_language_model": language_model.op2_language_model,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language_id.op4_language_id,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": token_count.op8_token_counts,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_suffix_array_dedup": suffix_array.op11_suffix_array_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
SQL = topk.SQL | decontaminate.SQL | near_dedup.SQL | substring_dedup.SQL | suffix_array.SQL | collocations.SQL | merkle.SQL
