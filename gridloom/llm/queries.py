"""The operators' queries and, where SQL expresses one, its SQL."""

from __future__ import annotations

from gridloom.llm import decontaminate, dialogue, embedding_join, jaccard_join, language_id, line_dedup, main_text, merkle, packing, ranked_search, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_dialogue_perspectives": dialogue.op2_dialogue_perspectives,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_main_text": main_text.op5_main_text,
    "op6_embedding_near_dedup": embedding_join.op6_embedding_near_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op2_dialogue_perspectives": dialogue.SQL,
    "op4_ngram_jaccard_join": jaccard_join.SQL,
    "op6_embedding_near_dedup": embedding_join.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
