"""All registered queries by name: (Spark function, oracle SQL or None)."""

from __future__ import annotations

from folioscope.plans import linking_queries, portfolio_queries, source_queries, text_queries

REGISTERED: dict = {**portfolio_queries.QUERIES, **text_queries.QUERIES, **linking_queries.QUERIES, **source_queries.QUERIES}
