"""The opN_<name> queries and their SQL twins."""

from __future__ import annotations

from carelake.llm import (
    chat, decontam, langid, line_dedup, mixing, ngram_join, ppm, prefix_trie, sharding, simhash, suffix_dedup, toxicity, vector_codes)

QUERIES = {
    "op1_mix_sources": (mixing.op1_mix_sources, mixing.OP1_SQL),
    "op2_language": (langid.op2_language, None),
    "op3_decontaminate": (decontam.op3_decontaminate, None),
    "op4_ppm_score": (ppm.op4_ppm_score, None),
    "op5_fingerprints": (simhash.op5_fingerprints, None),
    "op6_format_chats": (chat.op6_format_chats, chat.OP6_SQL),
    "op7_toxicity": (toxicity.op7_toxicity, None),
    "op8_shard_rows": (sharding.op8_shard_rows, sharding.OP8_SQL),
    "op9_ngram_join": (ngram_join.op9_ngram_join, None),
    "op10_suffix_dedup": (suffix_dedup.op10_suffix_dedup, suffix_dedup.OP10_SQL),
    "op11_prefix_trie": (prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL),
    "op12_vector_codes": (vector_codes.op12_vector_codes, vector_codes.OP12_SQL),
    "op13_line_dedup": (line_dedup.op13_line_dedup, line_dedup.OP13_SQL),
}
