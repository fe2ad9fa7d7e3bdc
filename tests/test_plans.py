"""What the plans look like: pushed filters, no needless shuffles, split skew."""

import pytest
from pyspark.sql import functions as F

from platewise.operators import joins, normalise, recode, rows as R, timeline
from platewise.schema import ANNOTATIONS, MARKS, READINGS, SERIES
from platewise.sources import tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    n = F.col("id")
    readings = spark.range(20000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (n % 7).cast("string"))).alias("date"),
        F.when(n % 3 == 0, "A1").otherwise(F.concat(F.lit("B"), (n % 11 + 1).cast("string"))).alias("well"),
        F.lit("Z").alias("param"), F.lit(4000).alias("freq"), (n / 300.0).alias("time_h"), (n % 97 + 1.0).alias("value"))
    tables.write_table(readings, f"{root}/readings", "overwrite")
    dates = readings.select("date").distinct()
    dates.select("date", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("time_h"), F.lit("x").alias("label")).write.parquet(
        f"{root}/marks")
    readings.select("date", "well").distinct().select("date", "well", F.lit("GF").alias("layer"), F.lit("VEGF").alias("value")).write.parquet(
        f"{root}/annotations")
    return (tables.read_table(spark, f"{root}/readings", READINGS), spark.read.schema(ANNOTATIONS).parquet(f"{root}/annotations"),
            spark.read.schema(MARKS).parquet(f"{root}/marks"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(stored):
    df = recode.exclude_dates(recode.select_readings(stored[0], param="Z", freq=4000), ["hot"]).select("well", "value")
    text = plan(df)
    assert "EqualTo(param,Z)" in text and "EqualTo(freq,4000)" in text
    assert "PartitionFilters: [isnotnull(date" in text or "PartitionFilters: [NOT (date" in text
    assert "ReadSchema: struct<well:string,param:string,freq:int,value:double>" in text


def test_readings_are_not_shuffled_to_meet_small_tables(stored):
    readings, annotations, marks = stored
    for df in (timeline.segment_by_marks(readings, marks), timeline.rebase_to_mark(readings, timeline.release_time(marks)),
               joins.annotate(readings, joins.widen_annotations(annotations))):
        text = final_plan(df)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("== Initial Plan ==")[0]


def test_first_rows_are_limited_before_the_shuffle(stored):
    text = plan(R.edge_rows(stored[0], SERIES, 3))
    assert text.count("WindowGroupLimit") == 2
    after = text.split("Exchange hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in after and "Partial" in after


def test_cells_combine_before_the_shuffle(stored):
    text = plan(timeline.hourly_cells(stored[0], SERIES))
    assert text.index("Exchange") > text.index("HashAggregate") and "partial_sum" in text.split("Exchange")[1]


def test_windows_never_span_all_readings(stored):
    readings = stored[0]
    for df in (normalise.normalise(readings, SERIES, "div_head"), timeline.hour_bins(readings, ["date"]),
               R.number_rows(readings, SERIES), R.following_values(readings, SERIES)):
        assert "Exchange SinglePartition" not in plan(df)
    # Bins over all rows: the one unpartitioned window runs over distinct hours.
    single = plan(timeline.hour_bins(readings, [])).split("Exchange SinglePartition")
    assert len(single) == 2 and single[1].split("\n")[1].strip().startswith("+- HashAggregate(keys=[_hour")


def test_skewed_series_are_split(spark, stored):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        readings = stored[0].repartition(20)
        wide = joins.widen_annotations(stored[1], {"GF": "gf"})
        for df in (normalise.normalise(readings, SERIES, "div_first"), normalise.normalise(readings, SERIES, "div_head"),
                   timeline.rebase_to_start(readings), timeline.segment_by_marks(readings, stored[2]),
                   joins.annotate(readings, wide)):
            assert "SortMergeJoin(skew=true)" in final_plan(df)
            assert df.count() == 20000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_large_date_is_written_as_several_files(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "64KB")
    try:
        df = spark.range(60000).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("date"), F.lit("A1").alias("well"),
            F.lit("Z").alias("param"), F.lit(1).alias("freq"), F.rand(1).alias("time_h"), F.rand(2).alias("value"))
        tables.write_table(df.repartition(16), str(tmp_path / "t"), "overwrite")
        assert len(list((tmp_path / "t" / "date=hot").glob("*.parquet"))) > 1
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
