"""Means, spreads, quantiles, histograms and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.joins import attach
from platewise.operators.normalise import strict_mean
from platewise.operators.rows import running_totals


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value", na_rm: bool = True,
            out: str | None = None) -> DataFrame:
    """Replicate mean per key. Without `na_rm` one missing input makes the mean missing."""
    mean = F.avg(value) if na_rm else strict_mean(value)
    return df.groupBy(*keys).agg(mean.alias(out or value))


def cell_mean(na_rm: bool = True) -> Column:
    """Aggregate that finishes a mean from hourly cells (total, n, n_rows)."""
    mean = F.try_divide(F.sum("total"), F.sum("n"))
    return mean if na_rm else F.when(F.sum("n") == F.sum("n_rows"), mean)


def cells_mean_se(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """y, y_min, y_max as `mean_se` gives them for the values, finished from hourly cells with m2.

    Deviations of cell means are taken from the group's mean, found first: sums of squares less the square of a
    sum would cancel where values are large and close together.
    """
    used = cells.where(F.col("n") > 0).withColumn("_mean", F.col("total") / F.col("n"))
    means = used.groupBy(*keys).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("y"))
    off = F.col("_mean") - F.col("y")
    n, m2 = F.sum("n"), F.sum(F.col("m2") + F.col("n") * off * off)
    out = attach(used, means, list(keys), null_safe=True).groupBy(*keys).agg(
        F.first("y").alias("y"), F.sqrt(F.when(n > 1, F.try_divide(F.try_divide(m2, n - 1), n))).alias("_se"))
    return out.withColumn("y_min", F.col("y") - F.col("_se")).withColumn("y_max", F.col("y") + F.col("_se")).drop("_se")


def summarise_experiments(df: DataFrame, keys: Sequence[str], value: str = "value", na_rm: bool = False) -> DataFrame:
    """mean, sd, n, se over experiments. n counts rows, missing values too; sd of one row is missing."""
    n = F.count(F.lit(1))
    whole = F.lit(True) if na_rm else F.count(F.lit(1)) == F.count(value)
    return df.groupBy(*keys).agg(
        F.when(whole, F.avg(value)).alias("mean"),
        F.when(whole, F.stddev_samp(value)).alias("sd"),
        n.alias("n"),
        F.when(whole, F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def two_stage_summary(df: DataFrame, keys: Sequence[str], experiment: Sequence[str] = ("date",),
                      value: str = "value", na_rm: bool = True) -> DataFrame:
    """Replicates are averaged inside each experiment first, experiments are summarised second."""
    inner = mean_by(df, [*experiment, *keys], value, na_rm)
    return summarise_experiments(inner, keys, value, na_rm=False)


def mean_se(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """y, y_min, y_max: mean and one standard error to either side; missing values are left out."""
    y, se = F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(y.alias("y"), (y - se).alias("y_min"), (y + se).alias("y_max"))


def mean_sd(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    y, sd = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*keys).agg(y.alias("y"), (y - sd).alias("y_min"), (y + sd).alias("y_max"))



def experiment_counts(df: DataFrame, keys: Sequence[str], over: str = "date") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(over).alias("n_experiments"))


def single_bin(df: DataFrame, at: int, name: str = "time_bin") -> DataFrame:
    return df.where(F.col(name) == at)


# --- quantiles --------------------------------------------------------------------------------------

def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float],
              parts: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) per key group.

    Equal values are counted together; the distinct ones are ranked by ranges of equal numbers of rows (`running_totals`), so
    no task holds a whole group, and an outlier does not gather the other values in one range.
    """
    keys = list(keys)
    counted = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, keys, ["_v"], "_n", "_upto", parts)
    totals = ranked.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    ranked = attach(ranked, totals, keys, null_safe=True)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))

    picks = []
    for name, p in probs.items():
        rank = F.floor((F.col("_total") - 1) * F.lit(float(p)))
        picks += [value_at(rank).alias(f"_a_{name}"), value_at(rank + 1).alias(f"_b_{name}")]
    found = ranked.groupBy(*keys, "_total").agg(*picks)
    out = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_a_{name}"), F.coalesce(F.col(f"_b_{name}"), F.col(f"_a_{name}"))
        out.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    return found.select(*keys, *out)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: min, quartiles, mean, max, number of missing values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("n_missing"))
    return attach(basic, quantiles(long, ["column"], "value", QUARTILES), ["column"], "left").select(
        "column", "min", "q1", "median", "mean", "q3", "max", "n_missing")


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, n) of text columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, keys: Sequence[str], col: str = "value") -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 interquartile ranges of the box) and outlier count."""
    keys = list(keys)
    v, reach = F.col(col), (F.col("q3") - F.col("q1")) * 1.5
    joined = attach(df.select(*keys, col), quantiles(df, keys, col, QUARTILES), keys, null_safe=True)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("lower"), F.max(F.when(inside, v)).alias("upper"),
        F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers"))


def histogram(df: DataFrame, col: str, panel: Sequence[str], split: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Counts in `bins` equal-width bins over each panel's range, split by further columns. Bins count from 1."""
    panel = list(panel)
    ends = df.groupBy(*panel).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    place = F.floor((F.col(col) - F.col("_lo")) * bins / width)
    bin_no = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)) + 1
    return attach(df.where(F.col(col).isNotNull()), ends, panel, null_safe=True).groupBy(
        *panel, *split, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Distinct values per key, in order."""
    return df.select(*keys, col).distinct().orderBy(*keys, col)


# --- samples ----------------------------------------------------------------------------------------

def _hash_of(columns: Sequence[str], seed: int) -> Column:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *text, F.lit(str(seed))))


def sample_groups(df: DataFrame, keys: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """All rows of k key groups, drawn by the order of a seeded hash: the same draw on any cluster."""
    keys = list(keys)
    drawn = df.select(*keys).distinct().orderBy(_hash_of(keys, seed), *keys).limit(k)
    return df.join(drawn, keys, "left_semi")


def sample_fraction(df: DataFrame, identity: Sequence[str], fractions: Mapping[str, float] | float,
                    stratum: str | None = None, seed: int = 1) -> DataFrame:
    """Rows whose seeded hash falls below the fraction (of their stratum): repeatable, no shuffle."""
    u = F.conv(F.substring(_hash_of(identity, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    if isinstance(fractions, Mapping):
        share = None
        for level, f in fractions.items():
            cond = F.col(stratum) == level
            share = F.when(cond, float(f)) if share is None else share.when(cond, float(f))
        share = share.otherwise(0.0)
    else:
        share = F.lit(float(fractions))
    return df.where(u < share)
