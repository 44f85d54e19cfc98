"""All queries of the panel engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from panelight.plans import capture_queries, model_queries, panel_queries, theme_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (theme_queries, panel_queries, capture_queries, model_queries):
    if both := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"queries named twice: {sorted(both)}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
