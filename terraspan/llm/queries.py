"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from terraspan.llm import (
    conversation_repair,
    decontaminate,
    html_extract,
    jaccard_join,
    language_id,
    packing,
    piece_sampling,
    prefix_trie,
    quality_rules,
    secret_scan,
    token_files,
    toxicity,
    vector_dedup,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op1_ablations": quality_rules.op1_ablations,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_vector_dedup": vector_dedup.op3_vector_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_language_id": language_id.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_piece_sampling": piece_sampling.op9_piece_sampling,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE = {}
for _m in (quality_rules, secret_scan, vector_dedup, jaccard_join, decontaminate, conversation_repair, prefix_trie):
    ORACLE |= _m.ORACLE
