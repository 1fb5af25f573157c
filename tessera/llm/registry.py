"""Queries of this subpackage and the SQL that says the same, by name."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, langid, mixing, near_dedup, negatives, packing, quality, sharding, topk, toxicity, trie

QUERIES = {
    "op1_topk_search": topk.query,
    "op2_quality_mil": quality.query,
    "op3_near_dedup": near_dedup.query,
    "op4_language_id": langid.query,
    "op5_bpe": bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_sharding": sharding.query,
    "op8_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_chat_format": chat.query,
    "op11_hard_negatives": negatives.query,
    "op12_best_fit_packing": packing.query,
    "op13_conversation_trie": trie.query,
}

#: The other queries have no SQL form and are tested against brute force, a round trip or held-out accuracy.
ORACLES = {
    "op1_topk_search": topk.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
}
