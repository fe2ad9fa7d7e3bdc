"""Dates set aside, ranks by ranges, linear hours, headers once per file, workbook identity, tails, overlapping ranges."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from platewise.functions.numbers import chi2_tail
from platewise.operators import diagnostics, joins, rows as R, summary, timeline
from platewise.plans import figures
from platewise.sources import files
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


# --- marks ------------------------------------------------------------------------------------------

MARKS = [("one", 5.0), ("four", 1.0), ("four", 2.0), ("four", 3.0), ("four", 4.0), ("good", 10.0), ("good", 20.0),
         ("same", 1.0), ("same", 1.0), ("same", 2.0), ("null", 1.0), ("null", None), ("early", 0.0), ("early", 3.0),
         ("three", 1.0), ("three", 2.0), ("three", 3.0)] + [("many", float(i)) for i in range(1, 500)]


def test_refused_dates_by_hand(spark):
    marks = spark.createDataFrame([(d, t, "x") for d, t in MARKS], "date string, time_h double, label string")
    dates = spark.createDataFrame([(d,) for d in ("good", "none", "one")], "date string")
    assert rows(timeline.refused_dates(marks)) == [
        ("early", 2, "a mark at or before the start"), ("four", 4, "more than three marks"), ("many", 499, "more than three marks"),
        ("null", 2, "a mark without a time"), ("one", 1, "fewer than two marks"), ("same", 3, "two marks at one time")]
    assert rows(timeline.refused_dates(marks, dates)) == [("none", 0, "no marks"), ("one", 1, "fewer than two marks")]
    assert {r[0] for r in rows(timeline.sound_marks(marks).select("date"))} == {"good", "three"}
    assert rows(timeline.refused_dates(marks.limit(0))) == []


def test_good_dates_get_their_phases_beside_bad_ones(spark):
    marks = spark.createDataFrame([(d, t, "x") for d, t in MARKS], "date string, time_h double, label string")
    df = spark.createDataFrame([(d, 15.0) for d in ("good", "one", "four", "none")], "date string, time_h double")
    assert rows(timeline.segment_by_marks(df, marks, on_invalid="drop")) == [("good", 15.0, "Starv")]
    with pytest.raises(Exception, match="two or three marks"):
        timeline.segment_by_marks(df, marks).collect()


# --- hours ------------------------------------------------------------------------------------------

def test_ten_thousand_hours_in_one_series(spark):
    df = spark.range(20000).select(F.lit("d").alias("date"), (F.col("id") / 2).alias("time_h"))
    cells = df.groupBy("date", F.floor("time_h").alias("hour"), (F.col("time_h") == F.floor("time_h")).alias("on_break")).count()
    cells = cells.cache()
    cells.count()
    out = timeline.hour_bins(cells, ["date"], hour="hour", on_break="on_break", windowed=True)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, 1" not in text and "unboundedfollowing" not in text.lower()
    start = time.time()
    got = {(r["hour"], r["on_break"]): r["time_bin"] for r in out.collect()}
    assert time.time() - start < 20
    assert got == {(h, b): (max(h, 1) if b else (h + 1 if h < 9999 else None)) for h in range(10000) for b in (True, False)}


def test_next_hour_of_runs_and_missing_hours(spark):
    rng = random.Random(4)
    data = [(f"g{rng.randint(0, 5)}", rng.choice([None, -3, 0, 1, 4, 4, 9]), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, hour long, id long")
    for g, h, i, nxt, rank in [tuple(r) for r in timeline.with_next_hour(df, ["g"], "hour").select("g", "hour", "id", "_next", "_rank").collect()]:
        hours = sorted({y for x, y, _ in data if x == g and y is not None})
        later = [y for y in hours if h is not None and y > h]
        assert (nxt, rank) == ((later[0] if later else None, hours.index(h) + 1) if h is not None else (None, None))


# --- ranks ------------------------------------------------------------------------------------------

def linear(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    lo = math.floor(h)
    return v[lo] + (h - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])


def test_quantiles_with_an_outlier(spark):
    rng = random.Random(1)
    data = [("a", rng.expovariate(1.0)) for _ in range(3000)] + [("a", 1e12), ("b", 7.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r[0]: r[1:] for r in summary.quantiles(df, ["k"], "v", summary.QUARTILES, parts=8).collect()}
    for k in ("a", "b", None):
        values = [v for x, v in data if x == k and v is not None]
        assert got[k] == pytest.approx([linear(values, p) for p in (0.25, 0.5, 0.75)])


def test_ranges_hold_equal_shares(spark, monkeypatch):
    """One value lies far out and one group has nearly all rows, yet no range holds more than a few times its share."""
    kept = []
    plain = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name="stage": kept.append(plain(df, name)) or kept[-1])
    df = spark.range(20000).select(F.when(F.col("id") < 10, F.lit("small")).otherwise("hot").alias("k"),
                                   F.when(F.col("id") == 77, 1e15).otherwise(F.exp(F.col("id") / 2000)).alias("v"), F.lit(1).alias("n"))
    out = R.running_totals(df, ["k"], ["v"], "n", parts=16)
    assert out.groupBy("k").agg(F.max("upto")).collect() and out.where("k = 'hot'").select("upto").distinct().count() == 19990
    sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 20000 / 16


# --- one pass for heads and starts ------------------------------------------------------------------

def test_release_figures_read_the_readings_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "only_readings")
    X.readings(spark, SF).write.parquet(path)
    readings, plans = spark.read.parquet(path), []
    plain = figures.materialise

    def note(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def noted(df, name="stage"):
        note(df)
        return plain(df, name)

    monkeypatch.setattr(figures, "materialise", noted)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for build in (figures.release_summary, figures.release_all_frequencies, figures.frequency_spectrum, figures.early_sirna):
            plans.clear()
            note(build(readings, X.annotations(spark, SF), X.marks(spark, SF)))
            assert sum(p.count("only_readings") for p in plans) == 2, build.__name__
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)


# --- chi-square -------------------------------------------------------------------------------------

#: Published upper points (degrees of freedom, probability, point).
POINTS = [(1, 0.05, 3.841459), (1, 0.01, 6.634897), (2, 0.05, 5.991465), (3, 0.95, 0.351846), (4, 0.05, 9.487729),
          (5, 0.001, 20.515006), (10, 0.99, 2.558212), (10, 0.005, 25.188180), (30, 0.5, 29.336032)]


def test_chi2_tail(spark):
    for k, p, x in POINTS:
        got = spark.createDataFrame([(x,)], "x double").select(chi2_tail("x", k)).first()[0]
        assert got == pytest.approx(p, abs=2e-6), (k, p)
    grid = [(i / 4,) for i in range(0, 400)] + [(None,), (-1.0,)]
    for r in spark.createDataFrame(grid, "x double").select("x", chi2_tail("x", 1), chi2_tail("x", 2)).collect():
        x, one, two = r
        if x is None:
            assert one is None and two is None
        else:
            assert one == pytest.approx(math.erfc(math.sqrt(max(x, 0) / 2)), rel=1e-9, abs=1e-300)
            assert two == pytest.approx(math.exp(-max(x, 0) / 2), rel=1e-9, abs=1e-300)


def test_box_test_needs_lags(spark):
    df = spark.createDataFrame([("a", float(i), float(i % 3)) for i in range(30)], "k string, time_h double, residual double")
    r = diagnostics.box_test(df, ["k"], lag=3, fitted=1).first()
    assert 0 <= r["p_value"] < 0.01
    with pytest.raises(ValueError):
        diagnostics.box_test(df, ["k"], lag=1, fitted=1)


# --- overlapping ranges -----------------------------------------------------------------------------

def test_overlap_join_against_definition(spark):
    rng = random.Random(9)
    inf = float("inf")
    points = [(i, rng.choice([None, float(rng.randint(-5, 30)), rng.uniform(-5, 30)])) for i in range(300)]
    ranges = [(j, a, a + rng.choice([0.0, 0.3, 1.0, 2.5, 17.0, 1000.0])) for j, a in enumerate(rng.uniform(-10, 30) for _ in range(80))]
    ranges += [(100, -inf, 3.0), (101, 3.0, inf), (102, -inf, inf), (103, None, 3.0), (104, 5.0, 4.0), (105, 4.0, 4.0), (106, 3.0, 4.0), (107, 50.0, inf)]
    df = spark.createDataFrame(points, "id long, v double")
    out = joins.overlap_join(df, spark.createDataFrame(ranges, "r long, lo double, hi double"), "v", width=0.7)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, r) for i, v in points for r, lo, hi in ranges if v is not None and lo is not None and lo < v <= hi)
    assert sorted((x["id"], x["r"]) for x in out.collect()) == want


# --- files ------------------------------------------------------------------------------------------

def test_headers_are_not_parsed_with_the_cells(spark):
    """A header is parsed below the explode of lines; no parse stands in a projection above or beside an explode of cells."""
    texts = spark.createDataFrame([("x/RUN_140419_MFT_1.xls/Z 4000 Hz.csv", "Time,A1 Z\n0,1\n")], "path string, content string")
    for df in (files.sheets_to_long(texts), files.read_modelled_v2(texts), files.plate_to_long(texts)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        explodes = [i for i, line in enumerate(plan) if "Generate " in line]
        assert explodes
        above = plan[:explodes[0]]
        assert not any("split(" in line for line in above)


def test_ragged_lines_and_short_heads(spark):
    text = "Time (hrs),A1 Z,B1 Z\n0.0,1\n0.5,2,3,4\n\n1.0\n"
    texts = spark.createDataFrame([("x/RUN_140419_MFT_1.xls/Z 4000 Hz.csv", text)], "path string, content string")
    got = [(r["time_h"], r["variable"], r["value"]) for r in files.sheets_to_long(texts).collect()]
    assert sorted(got, key=repr) == sorted([(0.0, "A1 Z", 1.0), (0.5, "A1 Z", 2.0), (0.5, "B1 Z", 3.0), (0.5, None, 4.0)], key=repr)


def test_two_workbooks_of_one_date_stay_apart(spark, tmp_path):
    for n in (1, 2):
        book = tmp_path / f"RUN_140419_MFT_{n}.xls"
        book.mkdir()
        (book / "Z 4000 Hz.csv").write_text(f"Time (hrs),A1 Z\n0.0,{n}\n")
        (book / "Comments.csv").write_text(f"<Mark> Time: {n}.5\n\nlabel {n}\n")
        (book / "Details.csv").write_text("title,\n" + "".join(f"key{i},value {n}{i}\n" for i in range(1, 9)))
    (tmp_path / "RUN_140419_Metadata_treatment.csv").write_text("\n".join([",".join("abcdefghijkl")] * 8))
    out = files.ingest_folder(spark, str(tmp_path), identity=True)
    assert rows(out["readings"].select("workbook", "value")) == [("RUN_140419_MFT_1.xls", 1.0), ("RUN_140419_MFT_2.xls", 2.0)]
    assert rows(out["marks"].select("workbook", "time_h", "label")) == [
        ("RUN_140419_MFT_1.xls", 1.5, "label 1"), ("RUN_140419_MFT_2.xls", 2.5, "label 2")]
    wide = files.details_wide(out["details"], {"key3": "third"})
    assert rows(wide.select("date", "workbook", "third")) == [
        ("140419", "RUN_140419_MFT_1.xls", "value 13"), ("140419", "RUN_140419_MFT_2.xls", "value 23")]
    assert out["annotations"].count() == 96 and out["modelled"].count() == 0
