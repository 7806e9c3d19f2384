"""What __spark_entry__.py registers of this subpackage."""

from __future__ import annotations

import importlib

# Module, query.
_NAMES = [
    ("op1_pii", "op1_weak_pii"),
    ("op2_urls", "op2_url_models"),
    ("op3_tokens", "op3_token_counts"),
    ("op4_decontaminate", "op4_winnowing"),
    ("op5_mixing", "op5_systematic_mix"),
    ("op6_simhash", "op6_simhash_covering"),
    ("op7_chat", "op7_prefix_targets"),
    ("op8_repeats", "op8_repeated_bytes"),
    ("op9_quality", "op9_quality_cascade"),
    ("op10_extract", "op10_template_extraction"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"braidwork.llm.{module}"), name) for module, name in _NAMES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"braidwork.llm.{module}"), "SQL", None) for module, name in _NAMES}
    return {name: sql for name, sql in found.items() if sql}
