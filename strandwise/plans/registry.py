"""All queries of the core and their SQL."""

from __future__ import annotations

from strandwise.plans import alignments, annotation_periods, discordance, events_queries, heavy_contigs, insertions, interval_queries, post_processing, refinement, text_functions, variants

MODULES = (annotation_periods, heavy_contigs, discordance, interval_queries, insertions, events_queries, text_functions, post_processing, variants, alignments, refinement)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
