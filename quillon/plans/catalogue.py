"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from quillon.plans import queries_data, queries_search

QUERIES = queries_search.QUERIES | queries_data.QUERIES
ORACLES = queries_search.ORACLES | queries_data.ORACLES
