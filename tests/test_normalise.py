import pytest
from pyspark.sql import functions as F

from platewise.operators.normalise import normalise
from tests.conftest import rows

KEYS = ["date", "well"]


@pytest.fixture(scope="module")
def series(spark):
    data = [("d", "A1", float(i), v) for i, v in enumerate([2.0, 4.0, 6.0, 8.0])]
    return spark.createDataFrame(data, "date string, well string, time_h double, value double").repartition(3)


@pytest.mark.parametrize("how, want", [
    ("raw", [2, 4, 6, 8]), ("div_first", [1, 2, 3, 4]), ("sub_first", [0, 2, 4, 6]), ("div_head", [.5, 1, 1.5, 2]),
    ("sub_head", [-2, 0, 2, 4]), ("sub_recycled", [0, 0, 0, 6]), ("div_tail", [1 / 3, 2 / 3, 1, 4 / 3]),
    ("minmax", [0, 1 / 3, 2 / 3, 1])])
def test_by_hand(series, how, want):
    assert [r[3] for r in rows(normalise(series, KEYS, how).select("date", "well", "time_h", "value"), "time_h")] == \
        pytest.approx(want)


def test_bin_baseline_and_zero_divisor(spark):
    df = spark.createDataFrame(
        [("d", "A1", -0.5, 0, 4.0), ("d", "A1", 0.5, 1, 8.0), ("d", "A2", -0.5, 0, 0.0), ("d", "A2", 0.5, 1, 8.0),
         ("d", "A3", 0.5, 1, 8.0)], "date string, well string, time_h double, time_bin int, value double")
    got = rows(normalise(df, KEYS, "div_bin").select("well", "time_bin", "value"))
    assert got == [("A1", 0, 1.0), ("A1", 1, 2.0), ("A2", 0, None), ("A2", 1, None), ("A3", 1, None)]


def test_short_series_and_ties(spark):
    df = spark.createDataFrame([("d", "A1", 1.0, 2, 5.0), ("d", "A1", 1.0, 1, 3.0)],
                               "date string, well string, time_h double, id int, value double")
    got = normalise(df, KEYS, "sub_first", order=("time_h", "id")).select("id", "value")
    assert rows(got) == [(1, 0.0), (2, 2.0)]
    assert rows(normalise(df, KEYS, "div_head", order=("time_h", "id")).select("id", "value")) == [(1, .75), (2, 1.25)]


def test_first_values_are_one_and_zero(spark):
    df = spark.range(3000).select(
        (F.col("id") % 7).cast("string").alias("date"), (F.col("id") % 11).cast("string").alias("well"),
        F.col("id").cast("double").alias("time_h"), (F.col("id") * 37 % 101 + 1).cast("double").alias("value"))
    for how, want in (("div_first", 1.0), ("sub_first", 0.0)):
        first = normalise(df, KEYS, how).groupBy(*KEYS).agg(F.min_by("value", "time_h").alias("v"))
        assert {r["v"] for r in first.collect()} == {want}
