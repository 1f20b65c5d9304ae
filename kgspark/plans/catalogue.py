"""All queries over the driver's tables, by name, with their DuckDB twins."""

from __future__ import annotations

from kgspark.plans import graph, labels, learning, linking, network, trials

MODULES = [graph, network, learning, trials, labels, linking]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
