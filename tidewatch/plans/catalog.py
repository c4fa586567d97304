"""All registered queries of the core engine and their SQL."""

from __future__ import annotations

from tidewatch.plans import evidence_queries, model_queries, research_queries, source_queries

QUERIES = model_queries.QUERIES | source_queries.QUERIES | research_queries.QUERIES | evidence_queries.QUERIES
ORACLE = model_queries.ORACLE | source_queries.ORACLE | research_queries.ORACLE | evidence_queries.ORACLE
