"""Operators for preparing training data, each with a query ``opN_<name>``."""

from __future__ import annotations

import importlib

#: Modules with a query, by the query's name.
MODULES = {
    "op1_nn_descent": "nndescent",
    "op2_license_scan": "licenses",
    "op3_hilbert_sharding": "hilbert",
    "op4_language_id": "langid",
    "op5_minhash_tensored": "minhash",
    "op6_best_fit_packing": "packing",
    "op7_decontamination": "tiling",
    "op8_ngram_trie_scores": "ngram",
    "op9_line_spread": "line_dedup",
    "op10_toxicity_neighbours": "toxicity",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __name__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express on whole tables."""
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f".{module}", __name__), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
