"""The operators' queries, by name, and their SQL."""

from __future__ import annotations

import importlib

_HERE = __name__.rsplit(".", 1)[0]

#: query name: module, function, and the module's SQL where there is one
QUERIES = {
    "op8_forest": ("forest", "op8_forest", None),
    "op2_vectors": ("vectors", "op2_vectors", None),
    "op7_jaccard": ("jaccard", "op7_jaccard", None),
    "op4_toxicity": ("toxicity", "op4_toxicity", None),
    "op3_langid": ("langid", "op3_langid", None),
    "op1_secrets": ("secrets", "op1_secrets", "SQL"),
    "op5_sstable": ("sstable", "op5_sstable", None),
    "op6_urls": ("urls", "op6_urls", "SQL"),
    "op9_mixing": ("mixing", "op9_mixing", "SQL"),
    "op10_bpe": ("bpe", "op10_bpe", None),
    "op11_spelling": ("spelling", "op11_spelling", None),
    "op13_suffixes": ("suffixes", "op13_suffixes", None),
    "op12_audit": ("diagrams", "op12_audit", "SQL"),
}


def _bound(module: str, function: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{_HERE}.{module}"), function)(spark, sf_dir)


def queries() -> dict:
    return {name: _bound(module, function) for name, (module, function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{_HERE}.{module}"), sql) for name, (module, _, sql) in QUERIES.items() if sql}
