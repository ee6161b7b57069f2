"""Registered queries over the tables-as-graph and the SQL that answers them."""

from . import entity_queries, feature_queries, fusion_queries, graph_queries, ingest_queries, report_queries, sample_queries

MODULES = (graph_queries, fusion_queries, report_queries, feature_queries, ingest_queries, sample_queries, entity_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}
