"""All queries of the subpackage and their SQL equivalents."""

from __future__ import annotations

from lexaria.llm import lang_queries, leak_queries, markup_queries, near_queries, page_queries, size_queries, term_queries

MODULES = [term_queries, size_queries, leak_queries, near_queries, lang_queries, page_queries, markup_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
