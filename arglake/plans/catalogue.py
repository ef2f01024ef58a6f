"""Query catalogue: the queries of all modules, with their oracle SQL."""

from __future__ import annotations

from arglake.plans import catalog_queries, graph_queries, log_queries, sampling_queries, text_queries, vector_queries

_MODULES = (text_queries, catalog_queries, sampling_queries, graph_queries, vector_queries, log_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.query.queries.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.query.oracle.items()}
