"""The operators' registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontamination, embeddings, language_id, lexical_search, ngram_join, packing, quality, spelling, substring_dedup, suffix_dedup, token_counts, warc

MODULES = (token_counts, chat, embeddings, substring_dedup, warc, packing, ngram_join, quality, decontamination, language_id, spelling, suffix_dedup, lexical_search)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
