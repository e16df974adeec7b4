"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_byte_bpe": "bpe",
    "op2_secret_scan": "secrets",
    "op3_decontamination": "decontam",
    "op4_toxicity": "toxicity",
    "op5_pii": "pii",
    "op6_simhash": "simhash",
    "op7_warc": "warc",
    "op8_quality_rules": "quality",
    "op9_language_id": "langid",
    "op10_token_rollup": "token_rollup",
    "op11_url_filter": "url_filter",
    "op12_vector_codes": "vector_codes",
    "op13_prefix_trie": "prefix_trie",
}

QUERIES = {name: getattr(import_module(f"matchloom.llm.{module}"), name) for name, module in _WHERE.items()}
ORACLES = {
    "op3_decontamination": import_module("matchloom.llm.decontam").ORACLE_OP3,
    "op11_url_filter": import_module("matchloom.llm.url_filter").ORACLE_OP11,
    "op12_vector_codes": import_module("matchloom.llm.vector_codes").ORACLE_OP12,
    "op13_prefix_trie": import_module("matchloom.llm.prefix_trie").ORACLE_OP13,
}
