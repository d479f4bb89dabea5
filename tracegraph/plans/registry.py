"""All queries of the package by name, with their SQL twins."""

from __future__ import annotations

from tracegraph.plans import file_keys, graph_keys, score_keys, source_keys  # noqa: F401  (all register into the tables of graph_keys)


def queries() -> dict:
    return dict(graph_keys.Q)


def oracle_sql() -> dict:
    return dict(graph_keys.SQL)
