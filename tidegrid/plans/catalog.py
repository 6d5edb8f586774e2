"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidegrid.plans import feature_queries, graph_queries, series_queries, skill_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (series_queries, graph_queries, feature_queries, skill_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
