"""Autoregression, autocorrelation and trend of every series at once, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import chi2_tail
from platewise.operators.joins import attach
from platewise.operators.rows import following_values
from platewise.schema import SERIES


def ar1_fit(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value",
            order: Sequence[str] = ("time_h",)) -> DataFrame:
    """phi, intercept, sigma2, n by conditional least squares: each value regressed on the one before it."""
    y, x = "next_1", value
    lagged = following_values(df.select(*by, *order, value), by, value, 1, order)
    phi = F.regr_slope(y, x)
    return lagged.where(F.col(y).isNotNull()).groupBy(*by).agg(
        phi.alias("phi"), F.regr_intercept(y, x).alias("intercept"),
        ((F.regr_syy(y, x) - phi * F.regr_sxy(y, x)) / F.regr_count(y, x)).alias("sigma2"),
        F.regr_count(y, x).alias("n"))


def ar1_residuals(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value", time: str = "time_h") -> DataFrame:
    """(by, time, residual): what the fit leaves of every value but the series' first."""
    points = df.select(*by, time, F.struct(time, value).alias("_p"))
    lagged = following_values(points, by, "_p", 1, (time,)).where(F.col("next_1").isNotNull())
    lagged = lagged.select(*by, F.col(f"_p.{value}").alias("_x"), F.col(f"next_1.{value}").alias("_y"),
                           F.col(f"next_1.{time}").alias(time))
    fit = lagged.groupBy(*by).agg(F.regr_slope("_y", "_x").alias("_phi"), F.regr_intercept("_y", "_x").alias("_c"))
    left = F.col("_y") - F.col("_c") - F.col("_phi") * F.col("_x")
    return attach(lagged, fit, by, null_safe=True).select(*by, time, left.alias("residual"))


def autocorrelation(df: DataFrame, by: Sequence[str] = SERIES, max_lag: int = 3, value: str = "value",
                    order: Sequence[str] = ("time_h",)) -> DataFrame:
    """(by, lag, r, n): products of deviations `lag` rows apart over the sum of squared deviations.

    The sum of products about the series' mean is the pairs' own covariance plus the product of how far the
    two ends' means lie from it, so one aggregate over the pairs gives it and no mean is joined first.
    """
    by, x = list(by), F.col(value)
    known = df.where(x.isNotNull()).select(*by, *order, value)
    ahead = following_values(known, by, value, max_lag, order)
    parts = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v")]
    for k in range(1, max_lag + 1):
        y = F.col(f"next_{k}")
        parts += [F.count(y).alias(f"_n{k}"), F.covar_pop(x, y).alias(f"_c{k}"),
                  F.avg(F.when(y.isNotNull(), x)).alias(f"_x{k}"), F.avg(y).alias(f"_y{k}")]
    sums = ahead.groupBy(*by).agg(*parts)

    def r(k: int):
        ends = (F.col(f"_x{k}") - F.col("_m")) * (F.col(f"_y{k}") - F.col("_m"))
        products = F.col(f"_n{k}") * (F.col(f"_c{k}") + ends)
        return F.try_divide(F.coalesce(products, F.lit(0.0)), F.col("n") * F.col("_v"))

    lags = F.array(*[F.struct(F.lit(k).alias("lag"), r(k).alias("r")) for k in range(1, max_lag + 1)])
    return sums.withColumn("_l", F.explode(lags)).select(*by, "_l.lag", "_l.r", "n")


def box_pierce(df: DataFrame, by: Sequence[str] = SERIES, lag: int = 1, value: str = "residual",
               order: Sequence[str] = ("time_h",), min_n: int = 0) -> DataFrame:
    """(by, q, n): number of values times the sum of squared autocorrelations up to `lag`.

    A series with fewer than `min_n` values stays, with a missing q: AR(1) residuals of up to three values are zero
    but for rounding, so their correlation means nothing.
    """
    acf = autocorrelation(df, by, lag, value, order)
    q = F.when(F.col("n") >= min_n, F.col("n") * F.sum(F.col("r") * F.col("r")))
    return acf.groupBy(*by, "n").agg(q.alias("q")).select(*by, "q", "n")


def box_test(df: DataFrame, by: Sequence[str] = SERIES, lag: int = 1, value: str = "residual",
             order: Sequence[str] = ("time_h",), min_n: int = 0, fitted: int = 0) -> DataFrame:
    """(by, q, n, p_value): `box_pierce` with the probability of a larger q were the values uncorrelated: that of a
    chi-square variable of `lag` less `fitted` (parameters fitted before) degrees of freedom."""
    if lag <= fitted:
        raise ValueError("more lags than fitted parameters are needed")
    return box_pierce(df, by, lag, value, order, min_n).withColumn("p_value", chi2_tail("q", lag - fitted))


def linear_trend(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value", time: str = "time_h") -> DataFrame:
    """(by, slope, intercept, r2, n) of the value against time in hours."""
    return df.groupBy(*by).agg(
        F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"),
        F.regr_r2(value, time).alias("r2"), F.regr_count(value, time).alias("n"))
