"""Queries of this subpackage, and the SQL for those that SQL can express."""

from lexmill.llm import align, archive, forest, jaccard, katz, media, mixing, odd, packing, substring, token_store, toxicity, trie

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_jaccard_join": jaccard.query,
    "op3_prefix_forest": forest.query,
    "op4_bm25_packing": packing.query,
    "op5_token_store": token_store.query,
    "op6_substring_dedup": substring.query,
    "op7_audio_features": media.query,
    "op8_katz_backoff": katz.query,
    "op9_arc_to_warc": archive.query,
    "op10_mixing": mixing.query,
    "op11_odd_sketches": odd.query,
    "op12_tokenizer_alignment": align.query,
    "op13_conversation_trie": trie.query,
}
ORACLES: dict[str, str] = {"op2_jaccard_join": jaccard.ORACLE, "op6_substring_dedup": substring.ORACLE, "op9_arc_to_warc": archive.ORACLE, "op10_mixing": mixing.ORACLE, "op11_odd_sketches": odd.ORACLE, "op13_conversation_trie": trie.ORACLE}
