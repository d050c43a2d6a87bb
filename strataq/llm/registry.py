"""Queries and SQL of the training-data operators, by registry key."""

from __future__ import annotations

from importlib import import_module

#: key: (module, query, name of the SQL text or None)
ENTRIES = {
    "op1_mixing": ("mixing", "op1_mixing", None),
    "op2_audio": ("audio", "op2_audio", None),
    "op3_decontaminate": ("decontaminate", "op3_decontaminate", "OP3_SQL"),
    "op4_quality": ("quality", "op4_quality", None),
    "op5_preferences": ("preferences", "op5_preferences", None),
    "op6_licenses": ("licenses", "op6_licenses", "OP6_SQL"),
    "op7_toxicity": ("toxicity", "op7_toxicity", None),
    "op9_pii": ("pii", "op9_pii", None),
    "op8_url_filter": ("url_filter", "op8_url_filter", "OP8_SQL"),
    "op10_jaccard": ("jaccard", "op10_jaccard", None),
}


def queries() -> dict:
    return {k: getattr(import_module(f".{m}", __package__), f) for k, (m, f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: getattr(import_module(f".{m}", __package__), s) for k, (m, _, s) in ENTRIES.items() if s}
