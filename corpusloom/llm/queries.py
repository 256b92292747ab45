"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from corpusloom.llm import chat_format, decontamination, filter_audit, html_extract, language_id, license_scan, lm_scoring, near_dedup, packing, prefix_trie, quality_rules, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_language_id": language_id.op3_language_id,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
