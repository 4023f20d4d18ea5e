"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from terravane.llm import bpe, chat_format, contracts, decontaminate, language_id, lm_score, merkle, mixing, near_dedup, pii, prefix_trie, quality_rules, secret_scan, url_rules

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_url_filters": url_rules.op8_url_filters,
    "op9_pii": pii.op9_pii,
    "op10_secret_scans": secret_scan.op10_secret_scans,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_bpe": bpe.op13_bpe,
    **contracts.QUERIES,
}

ORACLES = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op8_url_filters": url_rules.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    **contracts.ORACLES,
}
