"""All queries over the general tables: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from cytoframe.plans import calling_queries, cluster_queries, interval_queries, model_queries, read_queries, realign_queries, stream_queries, table_queries

QUERIES = read_queries.QUERIES | interval_queries.QUERIES | model_queries.QUERIES | cluster_queries.QUERIES | calling_queries.QUERIES | stream_queries.QUERIES | table_queries.QUERIES
QUERIES |= realign_queries.QUERIES
