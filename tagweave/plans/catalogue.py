"""All registered queries with their SQL oracles."""

from __future__ import annotations

from . import part_queries, search_queries, substring_queries, tag_queries, text_queries

MODULES = [search_queries, tag_queries, text_queries, part_queries, substring_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
