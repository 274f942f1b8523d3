"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

import importlib.util

_NAMES = {
    "op1_decontaminate": "decontaminate",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_warc_index": "warc",
    "op4_knn_join": "knn",
    "op5_quality": "quality",
    "op6_sharding": "sharding",
    "op7_lm_scoring": "lm",
    "op8_chat_formatting": "chat",
    "op9_jaccard_join": "jaccard",
    "op10_sentencepiece": "pieces",
    "op11_vector_codes": "codes",
    "op12_token_files": "token_files",
    "op13_fill_in_middle": "fim",
}


def queries() -> dict:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), q) for q, m in _NAMES.items() if importlib.util.find_spec(f"{__package__}.{m}")}


def oracle_sql() -> dict:
    out = {}
    for q in queries():
        sql = getattr(importlib.import_module(f"{__package__}.{_NAMES[q]}"), q.split("_")[0].upper() + "_SQL", None)
        if sql:
            out[q] = sql
    return out
