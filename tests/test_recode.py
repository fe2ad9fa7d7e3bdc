import pytest
from pyspark.sql import functions as F

from platewise.functions import numbers, text
from platewise.operators import recode
from tests.conftest import rows


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_dose_classes(spark):
    got = column(spark, [0.0, 1.0, 126.0, 400.0, 1265.0, 16000.0, 16002.0, -1.0, None], "double",
                 lambda c: numbers.cut_breaks(c, numbers.DOSE_BREAKS, include_lowest=True))
    assert got == ["[0,1]", "[0,1]", "(1,128]", "(128,402]", "(402,1.27e+03]", "(1.26e+04,1.6e+04]", None, None, None]
    assert column(spark, [0.0, 1.0], "double", lambda c: numbers.cut_breaks(c, [0, 1], ["x"])) == [None, "x"]
    with pytest.raises(ValueError):
        numbers.cut_breaks("x", [0, 1, 2], ["one"])


def test_break_labels_keep_neighbours_apart():
    assert numbers.break_labels([1.0001, 1.0002, 2]) == ["(1.0001,1.0002]", "(1.0002,2]"]


def test_micromolar_rounds_the_stored_number(spark):
    assert column(spark, [1265.0, 125.0, 4000.0, 1035.0, 12640.0, 126.0], "double", numbers.to_micromolar) == [
        1.26, 0.12, 4.0, 1.03, 12.64, 0.13]


def test_unlog_and_pool(spark):
    import math
    logs = [math.log10(x) for x in (1, 2, 7, 8, 25, 79, 316)]
    assert column(spark, logs, "double", numbers.unlog) == [1, 2, 7, 8, 25, 79, 316]
    assert column(spark, [1.0, 6.0, 8.0, 251.0], "double", lambda c: numbers.pool_values(c, numbers.POOL_GDF2)) == [
        2.0, 7.0, 8.0, 316.0]


def test_number_labels(spark):
    assert column(spark, [25.0, 25.5, 0.0, -0.0, 999.5, 16000.0], "double", text.number_label) == [
        "25", "25.5", "0", "0", "999.5", "16000"]


def test_text_to_number_does_not_fail(spark):
    assert column(spark, ["5000", "UT", "", None, "1e3"], "string", text.to_number) == [5000.0, None, None, None, 1000.0]


def test_comparison_label(spark):
    df = spark.createDataFrame([(25.0, "VEGF", "SB101-Fc"), (0.0, "VEGF", "hIgG-Fc")], "conc double, gf string, treatment string")
    got = df.select(text.comparison_label("conc", "gf", "treatment", recode.LABEL_RENAMES_V2)).collect()
    assert [r[0] for r in got] == ["25 ng/ml VEGF\n+3MUT-Fc", "0 ng/ml VEGF\n+rhIgG-Fc"]


def test_effective_doses_versions_agree_on_published_doses(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 126.0, 400.0, 999.5, 1000.0, 1264.9, 4000.0)], "dose double")
    a, b = recode.effective_doses(df), recode.effective_doses(df, ceil_first=True)
    assert rows(a) == rows(b) == [(0.0,), (1265.0,), (4000.0,)]


def test_relevel_and_units(spark):
    df = spark.createDataFrame([("bFGF",), ("HGF",), (None,)], "gf string")
    got = rows(recode.relevel(df, "gf", list(recode.GF_LABELS), recode.GF_LABELS), "gf_ord")
    assert got[0] == ("FGF2", 4) and got[1] == got[2] == (None, None)
    assert column(spark, [64000], "int", lambda c: F.concat(text.number_label(c.cast("double")), F.lit(" Hz"))) == ["64000 Hz"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None, None, 1.0), (2, "x", None, "y", 1.0)],
                               "a int, b string, c string, d string, e double")
    assert recode.drop_constant_columns(df).columns == ["a", "d"]


def test_complete_cases_drops_nan(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (None, "x"), (2.0, None)], "a double, b string")
    assert rows(recode.complete_cases(df)) == [(1.0, "x")]


def test_group_label_takes_the_second(spark):
    df = spark.createDataFrame([("p", "VEGF", 0.0), ("p", "VEGF", 25.0), ("q", "FBS_5", 0.0)], "k string, gf string, conc double")
    assert rows(recode.group_label(df, ["k"])) == [("p", "VEGF-25"), ("q", "FBS_5-0")]


def test_dates(spark):
    assert [str(x) for x in column(spark, ["20131213", "131213", "x", None], "string", text.parse_date)] == [
        "2013-12-13", "2013-12-13", "None", "None"]
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "date string")
    assert rows(recode.exclude_first_date(df)) == [("b",), ("c",)]
    assert rows(recode.exclude_dates(df, ["c"])) == [("a",), ("b",)]
