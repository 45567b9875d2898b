"""All queries of the engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .queries import columns, contracts, economics, evidence, extra, geometry, graph, impact, more, sinks, spatial, stats, temporal

FLAGSHIP = "p01_propagate"
MODULES = (temporal, graph, impact, stats, economics, spatial, evidence, more, extra, sinks, contracts, geometry, columns)


def queries() -> dict:
    return {key: query for module in MODULES for key, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in MODULES for key, (_, sql) in module.QUERIES.items() if sql}
