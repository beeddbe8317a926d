"""The queries of the corpus operators and the SQL that some of them equal."""

from __future__ import annotations

from importlib import import_module

MODULES = ["lm_scoring", "bpe", "html_extraction", "decontamination", "license_scan", "url_filter", "pii", "embedding_dedup", "jaccard_join", "toxicity", "sentence_pieces", "ranked_search", "schema_rewrite"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", {}).items()}
