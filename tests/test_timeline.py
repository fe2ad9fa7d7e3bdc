import math
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import timeline
from tests.conftest import rows

TIMES = [0.0, 0.3, 0.9, 1.0, 1.2, 2.5, 5.0, 5.1, 7.0, 7.2]


def test_hour_bins_by_hand(spark):
    df = spark.createDataFrame([("d", t) for t in TIMES], "date string, time_h double")
    ordinal = [r[2] for r in rows(timeline.hour_bins(df), "time_h")]
    label = [r[2] for r in rows(timeline.hour_bins(df, out="label"), "time_h")]
    assert ordinal == [1, 1, 1, 1, 2, 3, 3, 4, 4, None]
    assert label == [1, 1, 1, 1, 2, 5, 5, 7, 7, None]


def literal_bin(t, times, out):
    """The definition: breaks are the distinct whole hours, intervals (a, b], the lowest closed."""
    breaks = sorted({math.floor(x) for x in times})
    if len(breaks) < 2 or t is None:
        return None
    for i, (a, b) in enumerate(zip(breaks, breaks[1:]), 1):
        if a < t <= b or (i == 1 and t == a):
            return i if out == "ordinal" else b
    return None


@pytest.mark.parametrize("out", ["ordinal", "label"])
@pytest.mark.parametrize("windowed", [False, True])
def test_hour_bins_against_definition(spark, out, windowed):
    rng = random.Random(3)
    data = []
    for g in range(60):
        for _ in range(rng.randint(1, 20)):
            t = rng.uniform(-6, 12)
            data.append((f"g{g}", float(round(t)) if rng.random() < 0.3 else t))
    data = sorted(set(data))
    df = spark.createDataFrame(data, "date string, time_h double")
    df = df.withColumn("hour", F.floor("time_h")).withColumn("on_break", F.col("time_h") == F.col("hour"))
    got = timeline.hour_bins(df, ["date"], out=out, hour="hour", on_break="on_break", windowed=windowed)
    groups = {}
    for g, t in data:
        groups.setdefault(g, []).append(t)
    want = sorted(((g, t, literal_bin(t, groups[g], out)) for g, t in data), key=lambda r: r[:2])
    assert rows(got.select("date", "time_h", "time_bin"), "date", "time_h") == want


def test_segments_by_hand(spark):
    three = [("a", t) for t in (0.0, 0.1, 10.0, 10.1, 20.0, 20.1, 30.0, 30.1, 40.0)]
    two = [("b", t) for t in (10.0, 10.1, 20.0, 20.1)]
    df = spark.createDataFrame(three + two, "date string, time_h double")
    marks = spark.createDataFrame(
        [("a", 20.0, "x"), ("a", 10.0, "x"), ("a", 30.0, "x"), ("b", 10.0, "x"), ("b", 20.0, "x")],
        "date string, time_h double, label string")
    got = [r[2] for r in rows(timeline.segment_by_marks(df, marks), "date", "time_h")]
    assert got == [None, "Seed", "Seed", "Starv", "Starv", "Preinc", "Preinc", "Release", "Release",
                   "Seed", "Starv", "Starv", "Release"]


def test_other_numbers_of_marks_are_errors(spark):
    df = spark.createDataFrame([("a", 1.0)], "date string, time_h double")
    for n in (0, 1, 4, 9):
        marks = spark.createDataFrame([("a", float(i), "x") for i in range(n)], "date string, time_h double, label string")
        assert timeline.segment_by_marks(df, marks, on_invalid="null").first()["mark"] is None
        with pytest.raises(Exception, match="two or three marks"):
            timeline.segment_by_marks(df, marks).collect()


def test_phase_durations(spark):
    marks = spark.createDataFrame(
        [("a", 10.0, ""), ("a", 25.0, ""), ("a", 26.0, ""), ("b", 12.0, ""), ("b", 24.0, ""), ("b", 27.0, "")],
        "date string, time_h double, label string")
    assert rows(timeline.phase_durations(marks), "date") == [("a", 1.0, 16.0), ("b", 3.0, 15.0)]
    got = dict(rows(timeline.phase_duration_summary(marks)))
    assert got == pytest.approx({"preinc_mean": 2.0, "preinc_se": 1.0, "starv_mean": 15.5, "starv_se": 0.5})


def test_horizon_is_a_cut_not_a_filter(spark):
    seen = {1: "abc", 2: "abc", 3: "a", 4: "ab", 5: "a"}
    df = spark.createDataFrame([(d, b) for b, ds in seen.items() for d in ds], "date string, time_bin int")
    assert sorted({r[1] for r in rows(timeline.replicated_horizon(df))}) == [1, 2, 3, 4]


def test_common_length_and_alignment(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)] + [("b", i) for i in (1, 2, 3)], "date string, time_bin int")
    assert {r[1] for r in rows(timeline.common_length(df))} == {1, 2, 3}
    assert rows(timeline.align_right(df)) == [
        ("a", -3), ("a", -2), ("a", -1), ("a", 0), ("b", -2), ("b", -1), ("b", 0)]


def test_release_and_rebase(spark):
    marks = spark.createDataFrame([("a", 5.0, "Starv"), ("a", 9.0, "GF 1"), ("a", 11.0, "other")],
                                  "date string, time_h double, label string")
    assert rows(timeline.release_time(marks)) == [("a", 11.0)]
    assert rows(timeline.release_time(marks, label_like="GF")) == [("a", 9.0)]
    df = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "date string, time_h double")
    assert rows(timeline.rebase_to_mark(df, timeline.release_time(marks))) == [("a", -1.0), ("b", None)]
    assert rows(timeline.rebase_to_start(df)) == [("a", 0.0), ("b", 0.0)]
