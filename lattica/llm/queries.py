"""The corpus queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: (query, module, function, name of its SQL)
_OPS = [
    ("op1_substring_dedup", "substring", "op1_substring_dedup", None),
    ("op2_secrets", "secretscan", "op2_secrets", None),
    ("op3_mix_sources", "mix", "op3_mix_sources", "OP3_SQL"),
    ("op4_toxicity", "toxicity", "op4_toxicity", None),
    ("op5_media", "media", "op5_media", None),
    ("op6_bpe", "bpe", "op6_bpe", None),
    ("op7_langid", "langid", "op7_langid", None),
    ("op8_token_files", "tokenfile", "op8_token_files", None),
    ("op9_near_duplicates", "near", "op9_near_duplicates", None),
    ("op10_exact_dedup", "exact", "op10_exact_dedup", "OP10_SQL"),
]


def queries() -> dict:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), f) for q, m, f, _ in _OPS}


def oracle_sql() -> dict:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), s) for q, m, _, s in _OPS if s}
