"""All registered queries of the analytics and retrieval operators, with their SQL oracles."""

from __future__ import annotations

from . import audit_queries, chunking_queries, conversation_queries, ingest_queries, layout_queries, retrieval_queries

MODULES = (retrieval_queries, chunking_queries, conversation_queries, audit_queries, layout_queries, ingest_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.Q.queries.items()}
ORACLE_SQL: dict = {k: v for m in MODULES for k, v in m.Q.sql.items()}
