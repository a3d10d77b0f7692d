"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from strandwise.llm import best_mappings, file_pieces, size_percentiles, token_sizes, wrong_decoding

MODULES = (size_percentiles, file_pieces, best_mappings, token_sizes, wrong_decoding)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
