import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import summary, timeline
from platewise.operators.classify import classify_experiments, dates_of_class, layer_presence
from tests.conftest import rows


def test_quantiles_by_hand(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 10.0)] + [("b", 3.0)] + [("c", None)], "k string, v double")
    got = rows(summary.quantiles(df, ["k"], "v", summary.QUARTILES))
    assert got == [("a", 1.75, 3.0, 5.5), ("b", 3.0, 3.0, 3.0)]


def test_quantiles_against_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    data = [("hot", float(x)) for x in np.round(rng.exponential(5, 4000), 2)] + [
        (f"g{i % 9}", float(x)) for i, x in enumerate(rng.normal(0, 1, 300))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    probs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for buckets in (1, 16, 1024):
        for k, *got in rows(summary.quantiles(df, ["k"], "v", probs, buckets)):
            assert got == pytest.approx(list(np.quantile([v for g, v in data if g == k], list(probs.values()))))


def test_means_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, value double")
    assert rows(summary.mean_by(df, ["k"])) == [("a", 1.0), ("b", 3.0)]
    assert rows(summary.mean_by(df, ["k"], na_rm=False)) == [("a", None), ("b", 3.0)]
    got = rows(summary.summarise_experiments(df, ["k"]))
    assert got[0] == ("a", None, None, 2, None)
    assert got[1] == pytest.approx(("b", 3.0, statistics.stdev([2, 4]), 2, 1.0))
    one = summary.summarise_experiments(df.where("value = 1"), ["k"])
    assert rows(one) == [("a", 1.0, None, 1, None)]
    assert rows(summary.mean_se(df, ["k"]))[1] == pytest.approx(("b", 3.0, 2.0, 4.0))


def test_two_stages_equal_two_aggregates(spark):
    df = spark.range(400).select((F.col("id") % 5).alias("date"), (F.col("id") % 3).alias("k"),
                                 (F.col("id") * 31 % 17).cast("double").alias("value"))
    a = rows(summary.two_stage_summary(df, ["k"]))
    b = rows(summary.summarise_experiments(summary.mean_by(df, ["date", "k"]), ["k"]))
    assert a == b


def test_cells_finish_what_values_give(spark):
    rng = random.Random(8)
    data = [(f"k{i % 4}", rng.uniform(0, 9), rng.gauss(5000, 3) if rng.random() > .1 else None) for i in range(800)]
    df = spark.createDataFrame(data, "k string, time_h double, value double")
    cells = timeline.hourly_cells(df, ["k"], spread=True)
    got, want = rows(summary.cells_mean_se(cells, ["k"])), rows(summary.mean_se(df, ["k"]))
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9)


def test_histogram_holds_every_value(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(31)] + [("b", 5.0), ("b", 5.0)], "k string, v double")
    got = rows(summary.histogram(df, "v", ["k"], bins=30))
    assert sum(r[2] for r in got) == 33
    assert ("a", 30, 2) in got and ("b", 1, 2) in got


def test_box_and_profile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("a", None)], "k string, value double")
    assert rows(summary.box_stats(df, ["k"])) == [("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1)]
    assert rows(summary.profile(df, ["value"])) == [("value", 1.0, 2.0, 3.0, 22.0, 4.0, 100.0, 1)]


def test_samples_are_repeatable(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), "id")
    a = summary.sample_groups(df, ["k"], 5, seed=3)
    assert rows(a) == rows(summary.sample_groups(df.repartition(7), ["k"], 5, seed=3))
    assert a.select("k").distinct().count() == 5 and a.count() == 200
    share = summary.sample_fraction(df, ["id"], 0.25).count() / 2000
    assert 0.2 < share < 0.3


def test_experiment_classes(spark):
    layers = {"1": "a b", "2": "a b", "3": "a b c", "4": "a b c d"}
    df = spark.createDataFrame([(d, "A1", x, "v") for d, ls in layers.items() for x in ls.split()],
                               "date string, well string, layer string, value string")
    assert rows(classify_experiments(df)) == [("1", 1), ("2", 1), ("3", 2), ("4", 3)]
    assert rows(classify_experiments(df, k=2)) == [("1", 1), ("2", 1), ("3", 1), ("4", 2)]
    assert rows(classify_experiments(df, k=9)) == [("1", 1), ("2", 1), ("3", 2), ("4", 3)]
    with pytest.raises(ValueError):
        classify_experiments(df, max_signatures=2)
    assert rows(layer_presence(df))[2] == ("3", 1, 1, 1, 0)


def test_dates_of_class(spark):
    df = spark.createDataFrame([("1", "GF", "a"), ("1", "serum", "b"), ("2", "GF", "a"), ("2", "serum", None), ("3", "serum", "b"),
                                (None, "GF", "a"), ("4", None, "a")], "date string, layer string, value string")

    def dates(**options):
        return {r["date"] for r in dates_of_class(df, **options).collect()}

    assert dates(having=["GF"]) == {"1", "2", None} and dates(having=["GF", "serum"]) == {"1"}
    assert dates(having=["GF"], lacking=["serum"]) == {"2", None} and dates(lacking=["GF", "serum"]) == {"4"}
    assert dates() == {"1", "2", "3", "4", None} and dates(having=["none"]) == set()
