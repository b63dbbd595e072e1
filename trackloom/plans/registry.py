"""All queries on the bridge views and their DuckDB statements."""

from __future__ import annotations

from . import analytics, clusters, files, graphs, objects, quality_metrics, resolving, scalars, seeds, tracking, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (clusters, resolving, quality_metrics, analytics, seeds, windows, graphs, files, tracking, scalars, objects):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
