"""Registered queries over the given tables, and the SQL they are checked against."""


def load():
    """(queries, oracle SQL) of every check module."""
    from checks import figures, joining, recodes, reshaping, series, sources, summaries  # noqa: F401
    from checks.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
