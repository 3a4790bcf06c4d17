"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: query: its module here
_PLACES = {
    "op1_quality_rules": "quality",
    "op10_license_scan": "licenses",
    "op11_lm_scores": "automaton",
    "op12_source_divergence": "divergence",
    "op13_filter_audit": "audit",
    "op2_language_id": "language",
    "op3_vector_near_dedup": "vectors",
    "op4_substring_dedup": "substrings",
    "op5_chat_formatting": "chat",
    "op6_minhash_near_dedup": "neardup",
    "op7_bpe": "bpe",
    "op9_packing": "packing",
    "op8_url_filters": "urls",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _PLACES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in _PLACES.items()}
    return {name: sql for name, sql in found.items() if sql}
