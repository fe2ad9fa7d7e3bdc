"""Sorting, set operations, long and wide forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.recodes import ANNOTATED, annotated
from checks.registry import check, q6, r6
from platewise.operators import recode, reshape, summary
from platewise.sources import tables


@check("o1_sorted_values", "select distinct event_type, user_id from events")
def o1(spark, sf):
    return summary.distinct_values(X.table(spark, sf, "events"), ["event_type"], "user_id")


@check("o2_head", "select * from readings order by value desc, time_h limit 10", "readings")
def o2(spark, sf):
    return tables.preview(X.readings(spark, sf), 10, [F.col("value").desc(), F.col("time_h")])


@check("o3_factor_order", f"""with {ANNOTATED}
select gf, cast(case gf when 'FBS_5' then 1 when 'VEGF' then 2 when 'bFGF' then 3 end as integer) as gf_ord, count(*) as n
from a group by gf""", "readings wide")
def o3(spark, sf):
    df = recode.relevel(annotated(spark, sf), "gf", ["FBS_5", "VEGF", "bFGF"])
    return df.groupBy("gf", "gf_ord").agg(F.count(F.lit(1)).alias("n")).orderBy("gf_ord")


@check("o4_bind_rows", """select 'readings' as source, date, well, param, freq, time_h, value, null::double as drift, null::double as rmse from readings
union all select 'modelled', date, well, param, null, time_h, value, drift, rmse from modelled""", "readings modelled")
def o4(spark, sf):
    return reshape.bind_rows([X.readings(spark, sf), X.modelled(spark, sf)], ["readings", "modelled"])


@check("o5_set_difference", """select distinct user_id from events where event_type = 'view' except
  select user_id from events where event_type = 'purchase' and value > 150""")
def o5(spark, sf):
    ev = X.table(spark, sf, "events")
    return reshape.setdiff(ev.where("event_type = 'view'").select("user_id"),
                           ev.where("event_type = 'purchase' and value > 150").select("user_id"))


@check("o6_distinct", "select distinct date, well, param, freq from readings", "readings")
def o6(spark, sf):
    return X.readings(spark, sf).select("date", "well", "param", "freq").distinct()


@check("o7_gather", """select date, well, layer, value from (
  select date, well, unnest([{'layer': 'gf', 'value': gf}, {'layer': 'treatment', 'value': treatment},
  {'layer': 'serum', 'value': serum}], recursive := true) from wide)""", "wide")
def o7(spark, sf):
    from platewise.operators import joins
    wide = joins.widen_annotations(X.annotations(spark, sf)).select("date", "well", "gf", "treatment", "serum")
    return reshape.gather(wide, ["date", "well"], "layer", "value")


@check("o8_spread", """select date, well, max(value) filter (layer = 'GF') as gf, max(value) filter (layer = 'serum') as serum
  from annotations group by date, well""", "annotations")
def o8(spark, sf):
    return reshape.spread(X.annotations(spark, sf), ["date", "well"], "layer", "value", {"GF": "gf", "serum": "serum"})


@check("o8_spread_counts", """select date, well, count(*) filter (param = 'Z') as "Z", count(*) filter (param = 'R') as "R",
  count(*) filter (param = 'C') as "C" from readings group by date, well""", "readings")
def o8b(spark, sf):
    return reshape.spread(X.readings(spark, sf), ["date", "well"], "param", "value", ["Z", "R", "C"], "count")


@check("o9_transpose", """select c_custkey as id, c_name as name, c_mktsegment as segment from customer""")
def o9(spark, sf):
    c = X.table(spark, sf, "customer")
    long = reshape.gather(c.select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], "key", "value")
    return reshape.spread(long, [F.col("c_custkey").alias("id")], "key", "value",
                          {"c_name": "name", "c_mktsegment": "segment"})


@check("o10_split_apply", f"""select date, param, {q6('avg(value)')} as mean, count(*) as n, {q6('max(value) - min(value)')} as spread
  from readings group by date, param""", "readings")
def o10(spark, sf):
    return r6(X.readings(spark, sf).groupBy("date", "param").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("spread")))


@check("o11_plate_grid", "select d.date, w.well from (select distinct date from readings) d, wells w", "readings wells")
def o11(spark, sf):
    return reshape.plate_grid(X.readings(spark, sf))
