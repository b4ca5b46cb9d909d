"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, license_scan, mixing, pii, quality, secret_scan, simhash, spelling, toxicity, trie, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_bpe": bpe.op10_bpe,
    "op11_url_filters": url_filter.op11_url_filters,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_chat_formatting": chat_format.SQL,
    "op9_mixing": mixing.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_spelling_variants": spelling.SQL,
}
