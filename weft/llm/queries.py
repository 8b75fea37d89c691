"""The dealt operators' queries and their SQL, by registered name."""

from __future__ import annotations

from weft.llm import op1_kneser_ney, op2_pii, op3_quality, op4_packing, op5_string_tiling, op6_chat_repair, op7_language, op8_toxicity, op9_lsh_forest, op10_token_store, op11_prefix_trie, op12_line_dedup, op13_fill_in_middle

QUERIES = {
    "op1_kneser_ney": op1_kneser_ney.query,
    "op2_pii": op2_pii.query,
    "op3_quality": op3_quality.query,
    "op4_packing": op4_packing.query,
    "op5_string_tiling": op5_string_tiling.query,
    "op6_chat_repair": op6_chat_repair.query,
    "op7_language": op7_language.query,
    "op8_toxicity": op8_toxicity.query,
    "op9_lsh_forest": op9_lsh_forest.query,
    "op10_token_store": op10_token_store.query,
    "op11_prefix_trie": op11_prefix_trie.query,
    "op12_line_dedup": op12_line_dedup.query,
    "op13_fill_in_middle": op13_fill_in_middle.query,
}
ORACLE = {
    "op3_quality": op3_quality.ORACLE,
    "op11_prefix_trie": op11_prefix_trie.ORACLE,
    "op12_line_dedup": op12_line_dedup.ORACLE,
    "op13_fill_in_middle": op13_fill_in_middle.ORACLE,
}
