"""The registered queries and their SQL."""

from __future__ import annotations

from lakeloom.plans import classify, documents, graph, recommend, tables, timeseries

_ALL = (recommend, graph, timeseries, documents, classify, tables)
QUERIES: dict = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _ALL for name, sql in m.ORACLES.items()}
