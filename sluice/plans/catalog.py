"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from sluice.plans import queries_dispatch, queries_registry, queries_round

QUERIES: dict = queries_registry.QUERIES | queries_round.QUERIES | queries_dispatch.QUERIES
ORACLES: dict[str, str] = queries_registry.ORACLES | queries_round.ORACLES | queries_dispatch.ORACLES
