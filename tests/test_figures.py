"""Figure tables on experiments that have their own layers, and what they rest on, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from platewise.functions.numbers import to_places
from platewise.operators.summary import cells_mean_se
from platewise.operators.timeline import hourly_cells
from platewise.plans import figures
from platewise.sources import files
from tests.conftest import rows


@pytest.fixture(scope="module")
def plates(spark):
    """Two silencing experiments with four layers, one of them with a layer of its own kind on some wells, and two
    treatment experiments with six."""
    notes, values, marks = [], [], []
    for d in ("s1", "s2", "t1", "t2"):
        marks += [(d, 1.0, "Starv"), (d, 2.0, "GF added")]
        for w, treatment in (("A1", "siCD44"), ("A2", "SCR"), ("A3", "siCD44")):
            layers = {"GF": "VEGF", "conc_GF": "25", "celldensity": "5000",
                      "treatment": treatment if d[0] == "s" else "SB101-Fc"}
            if d[0] == "t":
                layers |= {"doses_treatment": "4000", "serum": "FBS"}
            if d[0] == "s" and w != "A3":
                layers["passage"] = "7"
            notes += [(d, w, k, v) for k, v in layers.items()]
            values += [(d, w, "Z", 4000, h / 4, 100.0 + h) for h in range(0, 29)]
    return (spark.createDataFrame(values, "date string, well string, param string, freq int, time_h double, value double"),
            spark.createDataFrame(notes, "date string, well string, layer string, value string"),
            spark.createDataFrame(marks, "date string, time_h double, label string"))


def test_silencing_needs_only_its_own_layers(plates):
    readings, notes, marks = plates
    hourly = figures.sirna_hourly(readings, notes, marks)
    got = {r["date"] for r in hourly.collect()}
    assert got == {"s1", "s2"}  # silencing experiments only, and these although they have no dose and serum layers
    shown = figures.sirna_summary(readings, notes, marks)
    assert shown.count() > 0 and shown.where("treatment is null").count() == 0
    around = figures.sirna_cells(readings, notes, marks)
    assert {r["date"] for r in around.select("date").distinct().collect()} == {"s1", "s2"}
    assert figures.early_sirna(readings, notes, marks).count() > 0


def test_every_layer_of_the_selection_counts(plates):
    readings, notes, marks = plates
    chosen = notes.where(F.col("date").isin("s1", "s2"))
    full = figures.wide_annotations(chosen, {"serum": "FBS"})
    # A3 lacks `passage`, a layer outside the named ones
    assert rows(full.select("date", "well", "full")) == [
        ("s1", "A1", True), ("s1", "A2", True), ("s1", "A3", False), ("s2", "A1", True), ("s2", "A2", True), ("s2", "A3", False)]


def test_barrier_resistance_takes_names_with_units(plates):
    readings, notes, marks = plates
    named = readings.drop("freq").withColumn("param", F.lit("Rb (ohm.cm^2)"))
    assert figures.barrier_resistance(named, notes, marks).count() > 0
    assert figures.barrier_resistance(named.withColumn("param", F.lit("Rbx")), notes, marks).count() == 0


def test_standard_error_of_large_close_values(spark):
    values = [1e8 + k / 100 for k in range(7)]
    df = spark.createDataFrame([("d", "A1", "Z", 1, i * 0.4, v) for i, v in enumerate(values)],
                               "date string, well string, param string, freq int, time_h double, value double")
    (r,) = cells_mean_se(hourly_cells(df, ["date", "well", "param", "freq"], spread=True), ["param"]).collect()
    mean = sum(values) / 7
    se = math.sqrt(sum((v - mean) ** 2 for v in values) / 6 / 7)
    assert r["y"] == pytest.approx(mean) and (r["y_max"] - r["y"]) == pytest.approx(se, rel=1e-3)


def test_workbooks_of_one_date_and_quoted_commas(spark):
    def book(n, *marks):
        text = "\n".join(x for t, label in marks for x in (f"<Mark> Time: {t}", "", label))
        return [(f"raw/RUN_140419_MFT_{n}.xls/Comments.csv", text),
                (f"raw/RUN_140419_MFT_{n}.xls/Details.csv", 'Parameter,Value\nOperator,"Smith, Jo"\nPlate,x')]
    texts = spark.createDataFrame(book(1, (1.5, "Starv"), (2.5, "GF")) + book(2, (3.5, "other")) + book(3, (9.0, "excluded")),
                                  "path string, content string")
    out = files.ingest(texts)
    assert rows(out["marks"]) == [("140419", 1.5, "Starv"), ("140419", 2.5, "GF"), ("140419", 3.5, "other")]
    assert ("140419", "Operator", "Smith, Jo") in rows(out["details"])


def _close_times(spark):
    """Two wells whose values lie a tenth of a microhour apart, and what belongs to them."""
    notes = [("d", w, k, v) for w in ("A1", "A2") for k, v in (("GF", "VEGF"), ("conc_GF", "8"), ("serum", "FBS"),
                                                                ("celldensity", "5000"))]
    values = [("d", "A1", "Rb", 4000, 3.0, 1.0), ("d", "A1", "Rb", 4000, 4.0, 2.0), ("d", "A2", "Rb", 4000, 4.0000001, 4.0)]
    marks = [("d", 1.0, "Starv"), ("d", 2.0, "GF added")]
    return (spark.createDataFrame(values, "date string, well string, param string, freq int, time_h double, value double"),
            spark.createDataFrame(notes, "date string, well string, layer string, value string"),
            spark.createDataFrame(marks, "date string, time_h double, label string"))


def test_modelled_setup_takes_times_at_six_places(spark):
    values, notes, _ = _close_times(spark)
    got = rows(figures.setup_overview_modelled(values.drop("freq"), notes).select("time_h", "y", "y_min"))
    assert got == [(0.0, 1.0, None), (1.0, 3.0, 2.0)]


def test_places_round_the_scaled_double(spark):
    got = spark.range(1).select(to_places(F.lit(1.0000005), nudge=0).alias("a"), to_places(F.lit(-1e-9)).alias("b"),
                                to_places(F.lit(8.5e-6 - 1e-8)).alias("c"), to_places(F.lit(None).cast("double")).alias("d"))
    half = (8.5e-6 - 1e-8 + 1e-8) * 1e6
    assert tuple(got.first()) == (math.floor(1.0000005 * 1e6 + 0.5) / 1e6, 0.0, math.floor(half + 0.5) / 1e6, None)


def test_setup_readings_take_times_at_six_places(spark):
    got = rows(figures.setup_overview(*_close_times(spark)).select("time_h", "y", "y_min"))
    assert got == [(0.0, 1.0, None), (1.0, 3.0, 2.0)]
