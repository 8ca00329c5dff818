"""Queries of the numbered operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from quire.llm import (decontaminate, exact_dedup, extraction, language, mixing, near_join, pii,
                       tokens, topk, toxicity, trie, warc, whitening)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_personal_data": pii.op2_personal_data,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_near_join": near_join.op4_near_join,
    "op5_warc": warc.op5_warc,
    "op6_html_text": extraction.op6_html_text,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_language_id": language.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_exact_topk": topk.op13_exact_topk,
}

ORACLE = {
    "op3_mix_sources": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_exact_topk": topk.ORACLE,
}
