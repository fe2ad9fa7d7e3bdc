import pytest
from pyspark.sql import functions as F

from platewise.operators import joins, reshape
from tests.conftest import rows


def test_pairs_by_hand(spark):
    df = spark.createDataFrame([("VEGF", c, i) for c in (0.0, 8.0, 25.0) for i in (1, 2)] + [("FBS", 0.0, 1)],
                               "gf string, conc double, i int")
    got = joins.pairs(df, ["gf"])
    sizes = {(r["gf"], r["pair_ind"]): r["count"] for r in got.groupBy("gf", "pair_ind").count().collect()}
    assert sizes == {("VEGF", 8.0): 4, ("VEGF", 25.0): 4, ("FBS", 0.0): 1}


def test_pairs_row_count_property(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("gf"), (F.col("id") * 7 % 5).cast("double").alias("conc"))
    n = {(r["gf"], r["conc"]): r["count"] for r in df.groupBy("gf", "conc").count().collect()}
    want = 0
    for gf in {g for g, _ in n}:
        concs = sorted(c for g, c in n if g == gf)
        want += n[gf, concs[0]] * (len(concs) - 1) + sum(n[gf, c] for c in concs[1:])
    assert joins.pairs(df, ["gf"]).count() == want


def test_pairs_with_given_control(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 9.0)], "gf string, conc double")
    assert rows(joins.pairs(df, ["gf"], control=5.0).select("pair_ind", "conc")) == [
        (0.0, 0.0), (0.0, 5.0), (9.0, 5.0), (9.0, 9.0)]


def test_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, b int")
    assert rows(joins.attach(a, b, ["k"])) == [("x", 1, 10)]
    assert rows(joins.natural_join(a, b)) == [("x", 1, 10), (None, 2, 20)]
    with pytest.raises(ValueError):
        joins.natural_join(a, b.select("b"))


def test_treated_dates_and_replicates(spark):
    df = spark.createDataFrame([("p", "d1", 0.0), ("p", "d1", 4000.0), ("p", "d2", 0.0)], "pair string, date string, dose double")
    assert {r["date"] for r in joins.dates_with_treated(df, ["pair"]).collect()} == {"d1"}
    assert joins.replicated_series(df, ["pair"]).count() == 3
    assert joins.replicated_series(df, ["pair"], min_n=3).count() == 0


def test_layers_not_named_are_carried(spark):
    df = spark.createDataFrame(
        [("d", "A1", "GF", "VEGF"), ("d", "A1", "passage", "3"), ("d", "A1", "passage", "4"), ("d", "A1", "medium", "M"),
         ("d", "A1", "void", None), ("d", "A1", None, "x"), ("d", "B1", "GF", "FBS")],
        "date string, well string, layer string, value string")
    got = {r["well"]: r for r in joins.widen_annotations(df).collect()}
    assert got["A1"]["gf"] == "VEGF" and got["A1"]["others"] == {"passage": "4", "medium": "M"}
    assert got["B1"]["others"] == {}
    assert "others" not in joins.widen_annotations(df, others=None).columns
    wide = joins.spread_layers(joins.widen_annotations(df), "passage", "medium", "none")
    assert {r["well"]: (r["passage"], r["medium"], r["none"]) for r in wide.collect()} == {
        "A1": ("4", "M", None), "B1": (None, None, None)}
    assert "others" not in wide.columns


def test_ranges(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 2.0, 9.0)], "date string, t double")
    ranges = spark.createDataFrame([("a", 0.0, 1.0, "lo"), ("a", 1.0, 2.0, "hi")], "date string, lo double, hi double, label string")
    assert rows(joins.assign_ranges(df, ranges, ["date"], "t")) == [("a", 1.0, "lo"), ("a", 1.5, "hi"), ("a", 2.0, "hi")]


def test_spread_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, n string, v int")
    assert rows(reshape.spread(df, ["k"], "n", "v", ["x", "y"])) == [("a", 1, 2), ("b", 3, None)]
    twice = df.union(df.limit(1))
    assert reshape.spread(twice, ["k"], "n", "v", ["x", "y"], "count").count() == 2
    with pytest.raises(Exception, match="duplicate keys"):
        reshape.spread(df.union(df), ["k"], "n", "v", ["x", "y"]).collect()


def test_grid_and_binding(spark):
    grid = reshape.plate_grid(spark.createDataFrame([("d",)], "date string"))
    wells = [r["well"] for r in grid.collect()]
    assert len(set(wells)) == 96 and "A1" in wells and "H12" in wells
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert rows(reshape.bind_rows([a, b], ["a", "b"]), "source") == [(1, "a", None), (None, "b", 2)]
