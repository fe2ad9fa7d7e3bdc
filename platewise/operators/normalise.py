"""Each series against its own baseline.

A baseline is one small row per series, found by an aggregate whose partial step runs before the shuffle,
and joined back. No window spans a series, so a series of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import safe_ratio
from platewise.operators.joins import attach
from platewise.operators.rows import edge_rows, number_rows

DIVIDE = {"div_first", "div_head", "div_tail", "div_bin"}
SUBTRACT = {"sub_first", "sub_head"}


def baseline(df: DataFrame, by: Sequence[str], how: str, value: str = "value",
             order: Sequence[str] = ("time_h",), n: int = 3, bin_name: str = "time_bin", at: int = 0) -> DataFrame:
    """(by, base): first value, mean of the first or last n, or mean inside one bin."""
    if how.endswith("_first"):
        rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        return df.groupBy(*by).agg(F.min_by(value, rank).alias("base"))
    if how.endswith("_head") or how.endswith("_tail"):
        rows = edge_rows(df.select(*by, *order, value), by, n, order, last=how.endswith("_tail"))
        return rows.groupBy(*by).agg(strict_mean(value).alias("base"))
    if how.endswith("_bin"):
        return df.groupBy(*by).agg(F.avg(F.when(F.col(bin_name) == at, F.col(value))).alias("base"))
    raise ValueError(f"unknown baseline: {how}")


def strict_mean(value: str) -> Column:
    """Mean that is NULL as soon as one input is."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.avg(value))


def normalise(df: DataFrame, by: Sequence[str], how: str, value: str = "value",
              order: Sequence[str] = ("time_h",), n: int = 3, bin_name: str = "time_bin", at: int = 0,
              out: str | None = None) -> DataFrame:
    """Add or replace the normalised value.

    raw            unchanged
    div_first      divided by the series' first value;      sub_first      minus it
    div_head       divided by the mean of its first n;      sub_head       minus it
    div_tail       divided by the mean of its last n
    div_bin        divided by its mean inside bin `at`
    sub_recycled   row i minus value (i-1) mod n + 1 of the series
    minmax         scaled to 0..1
    A zero divisor gives NULL.
    """
    by, out, v = list(by), out or value, F.col(value)
    if how == "raw":
        return df.withColumn(out, v)
    if how == "minmax":
        ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        scaled = safe_ratio(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return attach(df, ends, by, null_safe=True).withColumn(out, scaled).drop("_lo", "_hi")
    if how == "sub_recycled":
        head = edge_rows(df.select(*by, *order, value), by, n, order).groupBy(*by).agg(
            *[F.max(F.when(F.col("rn") == i, F.col(value))).alias(f"_head_{i}") for i in range(1, n + 1)])
        picked = F.element_at(F.array(*[f"_head_{i}" for i in range(1, n + 1)]),
                              ((F.col("_rn") - 1) % n + 1).cast("int"))
        joined = attach(number_rows(df, by, order, name="_rn"), head, by, null_safe=True)
        return joined.withColumn(out, v - picked).drop("_rn", *[f"_head_{i}" for i in range(1, n + 1)])
    base = baseline(df, by, how, value, order, n, bin_name, at).withColumnRenamed("base", "_base")
    joined = attach(df, base, by, null_safe=True)
    if how in DIVIDE:
        return joined.withColumn(out, safe_ratio(v, F.col("_base"))).drop("_base")
    if how in SUBTRACT:
        return joined.withColumn(out, v - F.col("_base")).drop("_base")
    raise ValueError(f"unknown normalisation: {how}")
