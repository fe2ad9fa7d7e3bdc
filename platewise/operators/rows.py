"""Row numbers and neighbours inside long series.

A series may hold a large part of all rows, so no window here spans a whole series: rows are numbered per
(series, time chunk), chunk sizes give the offsets, and neighbours are looked up in chunks that carry a margin
of the first rows after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.joins import attach
from platewise.session import materialise


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("time_h",), chunk: float = 1.0,
                name: str = "rn") -> DataFrame:
    """1-based position of each row in its series. The first order column is numeric; `chunk` is its step."""
    by = list(by)
    df = df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk))
    keys = [*by, "_chunk"]
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        attach(local, offsets, keys, null_safe=True)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_chunk", "_local", "_offset")
    )


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, out: str = "upto",
                   parts: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `weight` over the group's rows up to and with this one, in the order given.

    Rows are sorted by ranges of (by, order) whose edges come from a sample, so that each range holds about as many rows as
    any other, wherever the values lie and however large a group is. A row's total is that of the group's earlier ranges and
    the running sum inside its own. The ranges are written, since an edge must not move once it is counted by.
    """
    by, order = list(by), list(order)
    placed = df.repartitionByRange(parts, *by, *order) if parts else df.repartitionByRange(*by, *order)
    placed = materialise(placed.withColumn("_part", F.spark_partition_id()), "ranges")
    keys = [*by, "_part"]
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys).agg(F.sum(weight).alias("_size"))
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn(out, F.sum(weight).over(inside))
    return attach(local, starts, keys, null_safe=True).withColumn(out, F.col(out) + F.col("_start")).drop("_start", "_part")


def following_values(df: DataFrame, by: Sequence[str], value: str = "value", lags: int = 1,
                     order: Sequence[str] = ("time_h",), chunk: float = 1.0) -> DataFrame:
    """Adds `next_1 .. next_<lags>`: the values 1 .. `lags` rows later in the series, NULL past its end.

    Rows are looked at per (series, time chunk). The rows that follow a chunk are among the first `lags` of
    the chunks after it, so each chunk is given a margin of at most `lags` of those; the readings are
    shuffled once.
    """
    if lags < 1:
        raise ValueError("lags must be at least 1")
    by = list(by)
    cut = df.select(*by, *order, value, F.floor(F.col(order[0]) / chunk).alias("_chunk"))
    heads = edge_rows(cut, [*by, "_chunk"], lags, order).drop("rn")
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(-lags, -1)
    served = F.array_except(F.collect_set("_chunk").over(before), F.array("_chunk"))
    margin = heads.withColumn("_served", served).withColumn("_home", F.explode("_served")).drop("_served")
    margin = margin.withColumn("_own", F.lit(False))
    both = cut.withColumn("_home", F.col("_chunk")).withColumn("_own", F.lit(True)).unionByName(margin)
    w = Window.partitionBy(*by, "_home").orderBy(*order)
    ahead = both.select("*", *[F.lead(value, k).over(w).alias(f"next_{k}") for k in range(1, lags + 1)])
    return ahead.where("_own").drop("_chunk", "_home", "_own")


def edge_rows(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str] = ("time_h",),
              last: bool = False) -> DataFrame:
    """The first (or last) n rows of each series, numbered `rn` from that end.

    The limit is pushed below the shuffle, so at most n rows per series leave a task.
    """
    keys = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
