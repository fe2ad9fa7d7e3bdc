"""Operators for preparing training data: `load()` gives their queries and the SQL of those that SQL can state."""

from __future__ import annotations


def load():
    """(queries, oracle SQL) of this package."""
    from platewise.llm import queries
    return queries.QUERIES, queries.ORACLES
