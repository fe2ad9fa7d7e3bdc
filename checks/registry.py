"""Queries by name, each with the SQL that defines its result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PARTS = {
    "readings": X.SQL_READINGS,
    "annotations": X.SQL_ANNOTATIONS,
    "wide": X.SQL_WIDE,
    "others": X.SQL_OTHERS,
    "marks": X.SQL_MARKS,
    "spoiled": X.SQL_SPOILED,
    "modelled": X.SQL_MODELLED,
    "phased": X.SQL_PHASED,
    "wells": X.SQL_WELLS,
    "ann": X.SQL_ANN,
    "rel": X.SQL_RELEASE,
}


def check(name: str, sql: str | None = None, use: str = ""):
    """Register a query; `use` lists the derived tables that its SQL needs, in order."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            parts = ", ".join(PARTS[p] for p in use.split())
            if parts:
                text = f"with {parts}, {text[5:]}" if text.lower().startswith("with ") else f"with {parts} {text}"
            ORACLES[name] = text
        return fn
    return register


def r6(df: DataFrame, digits: int = 6, only: tuple = ()) -> DataFrame:
    """Doubles (or only those named) rounded.

    A hundred-millionth is added first: means of few decimals often lie exactly between two roundings, and
    engines that sum in different orders would then part there.
    """
    return df.select(*[
        (F.round(F.col(f.name) + F.lit(1e-8), digits) + F.lit(0.0)).alias(f.name) 
        if f.dataType.typeName() == "double" and (not only or f.name in only) else F.col(f.name)
        for f in df.schema.fields])


def q6(expr: str) -> str:
    return f"round({expr} + 1e-8, 6) + 0.0"
