"""All queries of the core with their SQL."""

from __future__ import annotations

from landweave.plans import delivered_queries, general_queries, reconcile_queries, record_queries

_PARTS = (delivered_queries, general_queries, reconcile_queries, record_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE: dict = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
