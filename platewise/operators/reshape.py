"""Long and wide forms, row binding, grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.schema import PLATE_COLS, PLATE_ROWS


def gather(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value",
           columns: Sequence[str] | None = None) -> DataFrame:
    return df.unpivot(list(ids), list(columns) if columns else None, name, value)


def spread(df: DataFrame, keys: Sequence[str], name: str, value: str, levels: Sequence[str] | Mapping[str, str],
           duplicates: str = "error") -> DataFrame:
    """One column per level. Two rows for one cell raise an error, or with duplicates='count' cells hold counts."""
    levels = dict(levels) if isinstance(levels, Mapping) else {x: x for x in levels}
    cells = []
    for level, out in levels.items():
        here = F.col(name) == level
        count = F.count(F.when(here, 1))
        if duplicates == "count":
            cells.append(count.alias(out))
        else:
            cells.append(F.when(count > 1, F.raise_error(F.lit(f"duplicate keys for {level}")))
                         .otherwise(F.max(F.when(here, F.col(value)))).alias(out))
    return df.groupBy(*keys).agg(*cells)


def bind_rows(dfs: Sequence[DataFrame], ids: Sequence[str] | None = None, id_name: str = "source") -> DataFrame:
    """Stack tables of differing columns; gaps become NULL; optionally name each row's source."""
    if ids is not None:
        dfs = [d.withColumn(id_name, F.lit(i)) for d, i in zip(dfs, ids)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b does not hold."""
    return a.subtract(b)


def well_name(row: Column, col: Column) -> Column:
    """Zero-based plate row and column to 'A1' .. 'H12'."""
    return F.concat(F.char(row + 65), (col + 1).cast("string"))


def plate_grid(df: DataFrame, key: str = "date") -> DataFrame:
    """Every well of the plate for every key present in `df`."""
    rows, cols = F.sequence(F.lit(0), F.lit(PLATE_ROWS - 1)), F.sequence(F.lit(0), F.lit(PLATE_COLS - 1))
    return (
        df.select(key).distinct()
        .withColumn("_c", F.explode(cols)).withColumn("_r", F.explode(rows))
        .select(key, well_name(F.col("_r"), F.col("_c")).alias("well"))
    )
