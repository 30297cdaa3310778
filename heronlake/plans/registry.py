"""All queries of the engine's own operators, and their DuckDB oracles."""

from __future__ import annotations

from heronlake.plans import catalog_queries, chunk_queries, lifecycle_queries, retrieval_queries, state_queries, text_queries

_MODULES = (retrieval_queries, chunk_queries, text_queries, state_queries, lifecycle_queries, catalog_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
