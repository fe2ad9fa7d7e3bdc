"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.recodes import NUMBERED, annotated, numbered
from checks.registry import check, q6, r6
from platewise.functions import numbers
from platewise.operators import classify, summary, timeline
from platewise.schema import LAYERS

_A1_KEYS = "freq, param, date, conc, dose, gf, treatment"


@check("a1_replicate_means", f"with {NUMBERED} select {_A1_KEYS}, {q6('avg(value)')} as value from a group by {_A1_KEYS}",
       "readings wide")
def a1(spark, sf):
    return r6(summary.mean_by(numbered(spark, sf), _A1_KEYS.split(", ")))


@check("a1_replicate_means_strict", f"""with {NUMBERED}, t as (select *, case when value < 5 then null else value end as v from a)
select date, well, param, case when count(v) = count(*) then {q6('avg(v)')} end as v from t group by date, well, param""",
       "readings wide")
def a1b(spark, sf):
    t = numbered(spark, sf).withColumn("v", F.when(F.col("value") < 5, None).otherwise(F.col("value")))
    return r6(summary.mean_by(t, ["date", "well", "param"], "v", na_rm=False))


_EXP = "date_means as (select date, param, freq, gf, avg(value) as value from a group by date, param, freq, gf)"


@check("a2_experiment_summary", f"""with {NUMBERED}, {_EXP}
select param, freq, gf, {q6('avg(value)')} as mean, {q6('stddev_samp(value)')} as sd, count(*) as n,
       {q6('stddev_samp(value) / sqrt(count(*))')} as se from date_means group by param, freq, gf""", "readings wide")
def a2(spark, sf):
    means = summary.mean_by(numbered(spark, sf), ["date", "param", "freq", "gf"])
    return r6(summary.summarise_experiments(means, ["param", "freq", "gf"]))


@check("a3_two_stage_summary", f"""with {NUMBERED}, m as (
  select date, conc, treatment, param, avg(value) as v from a group by date, conc, treatment, param)
select conc, treatment, param, {q6('avg(v)')} as mean, {q6('stddev_samp(v)')} as sd, count(*) as n,
       {q6('stddev_samp(v) / sqrt(count(*))')} as se from m group by conc, treatment, param""", "readings wide")
def a3(spark, sf):
    return r6(summary.two_stage_summary(numbered(spark, sf), ["conc", "treatment", "param"]))


@check("a4_mean_se", f"""with {NUMBERED}
select param, treatment, freq, {q6('avg(value)')} as y, {q6('avg(value) - stddev_samp(value) / sqrt(count(value))')} as y_min,
       {q6('avg(value) + stddev_samp(value) / sqrt(count(value))')} as y_max from a group by param, treatment, freq""",
       "readings wide")
def a4(spark, sf):
    return r6(summary.mean_se(numbered(spark, sf), ["param", "treatment", "freq"]))


@check("a5_mean_sd", f"""select date, param, {q6('avg(value)')} as y, {q6('avg(value) - stddev_samp(value)')} as y_min,
       {q6('avg(value) + stddev_samp(value)')} as y_max from readings group by date, param""", "readings")
def a5(spark, sf):
    return r6(summary.mean_sd(X.readings(spark, sf), ["date", "param"]))


@check("a6_experiment_counts", f"""with {NUMBERED} select gf, conc, treatment, count(distinct date) as n_experiments
  from a group by gf, conc, treatment""", "readings wide")
def a6(spark, sf):
    return summary.experiment_counts(numbered(spark, sf), ["gf", "conc", "treatment"])


@check("a7_release_time", """select m.date, max(m.time_h) as mark_h,
  (select min(time_h) from marks x where x.date = m.date and x.label like '%GF%') as gf_h,
  (select min(r.time_h) from phased r where r.date = m.date and r.mark = 'Release') as first_h
  from marks m group by m.date""", "readings marks phased")
def a7(spark, sf):
    m = X.marks(spark, sf)
    last = timeline.release_time(m)
    first_gf = timeline.release_time(m, "min", "GF").withColumnRenamed("mark_h", "gf_h")
    phased = timeline.segment_by_marks(X.readings(spark, sf), m).where(F.col("mark") == "Release")
    first = timeline.start_times(phased).withColumnRenamed("start_h", "first_h")
    return last.join(first_gf, "date", "left").join(first, "date", "left")


@check("a8_phase_durations", """with o as (select *, row_number() over (partition by date order by time_h) as i from marks)
select date, max(time_h) filter (i = 3) - max(time_h) filter (i = 2) as preinc,
       max(time_h) filter (i = 3) - max(time_h) filter (i = 1) as starv from o group by date""", "marks")
def a8(spark, sf):
    return timeline.phase_durations(X.marks(spark, sf))


@check("a8_phase_duration_summary_all_dates", f"""with o as (
  select *, row_number() over (partition by date order by time_h) as i from marks),
d as (select date, max(time_h) filter (i = 3) - max(time_h) filter (i = 2) as p,
             max(time_h) filter (i = 3) - max(time_h) filter (i = 1) as s from o group by date)
select 'preinc_mean' as variable, case when count(*) = count(p) then {q6('avg(p)')} end as value from d
union all select 'preinc_se', case when count(*) = count(p) then {q6('stddev_samp(p) / sqrt(count(*))')} end from d
union all select 'starv_mean', case when count(*) = count(s) then {q6('avg(s)')} end from d
union all select 'starv_se', case when count(*) = count(s) then {q6('stddev_samp(s) / sqrt(count(*))')} end from d""", "marks")
def a8c(spark, sf):
    return r6(timeline.phase_duration_summary(X.marks(spark, sf)))


# The same over the dates whose durations are known; those of two marks enter no mean.
@check("a8_phase_duration_summary", f"""with o as (
  select *, row_number() over (partition by date order by time_h) as i from marks),
d as (select date, max(time_h) filter (i = 3) - max(time_h) filter (i = 2) as p,
             max(time_h) filter (i = 3) - max(time_h) filter (i = 1) as s from o group by date)
select 'preinc_mean' as variable, {q6('avg(p)')} as value from d
union all select 'preinc_se', {q6('stddev_samp(p) / sqrt(count(p))')} from d
union all select 'starv_mean', {q6('avg(s)')} from d
union all select 'starv_se', {q6('stddev_samp(s) / sqrt(count(s))')} from d""", "marks")
def a8b(spark, sf):
    return r6(timeline.phase_duration_summary(X.marks(spark, sf), known_only=True))


@check("a9_replicated_horizon", """with t as (select date, well, time_h, cast(floor(time_h * 10) as integer) as time_bin from readings),
  c as (select time_bin, count(distinct date) as n from t group by time_bin)
select * from t where time_bin <= (select max(time_bin) from c where n >= 4)""", "readings")
def a9(spark, sf):
    t = X.readings(spark, sf).select("date", "well", "time_h", F.floor(F.col("time_h") * 10).cast("int").alias("time_bin"))
    return timeline.replicated_horizon(t, min_n=4)


@check("a9_replicated_horizon_all_wells", """with t as (
  select date, well, time_h, cast(floor(time_h * 10) as integer) as time_bin from readings),
c as (select time_bin, count(distinct date) as n from t group by time_bin)
select * from t where time_bin <= (select max(time_bin) from c where n >= 4)""", "readings")
def a9b(spark, sf):
    t = X.readings(spark, sf).select("date", "well", "time_h", F.floor(F.col("time_h") * 10).cast("int").alias("time_bin"))
    return timeline.replicated_horizon(t, min_n=4)


@check("a10_layer_presence", """select date, cast(max(case when layer = 'GF' then 1 else 0 end) as integer) as "GF",
  cast(max(case when layer = 'conc_GF' then 1 else 0 end) as integer) as "conc_GF",
  cast(max(case when layer = 'treatment' then 1 else 0 end) as integer) as "treatment",
  cast(max(case when layer = 'doses_treatment' then 1 else 0 end) as integer) as "doses_treatment",
  cast(max(case when layer = 'celldensity' then 1 else 0 end) as integer) as "celldensity",
  cast(max(case when layer = 'serum' then 1 else 0 end) as integer) as "serum" from annotations group by date""", "annotations")
def a10(spark, sf):
    return classify.layer_presence(X.annotations(spark, sf), list(LAYERS))


@check("a11_experiment_classes", """with s as (
  select date, string_agg(distinct layer, ',' order by layer) as sig from annotations group by date),
f as (select sig, row_number() over (order by min(date)) as c from s group by sig)
select date, cast(c as integer) as class from s join f using (sig)""", "annotations")
def a11(spark, sf):
    # These experiments have at most three distinct layer sets, so each set is a class of its own.
    return classify.classify_experiments(X.annotations(spark, sf))


@check("a11_wide_by_class", """with s as (
  select date, string_agg(distinct layer, ',' order by layer) as sig from annotations group by date),
f as (select sig, row_number() over (order by min(date)) as c from s group by sig)
select wide.* exclude (serum), coalesce(serum, 'FBS') as serum, cast(c as integer) as class
from wide join s using (date) join f using (sig)""", "wide")
def a11b(spark, sf):
    return classify.wide_by_class(X.annotations(spark, sf), others=None)


@check("a11_dates_of_class", """select date from annotations group by date
  having bool_or(layer = 'treatment') and not bool_or(layer = 'serum')""", "annotations")
def a11c(spark, sf):
    return classify.dates_of_class(X.annotations(spark, sf), having=("treatment",), lacking=("serum",))


@check("a12_profile", """with l as (
  select 'l_quantity' as "column", l_quantity as v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem
  union all select 'l_discount', l_discount from lineitem union all select 'l_linenumber', l_linenumber::double from lineitem)
select "column", min(v) as min, round(quantile_cont(v, 0.25) + 1e-8, 6) + 0.0 as q1, round(quantile_cont(v, 0.5) + 1e-8, 6) + 0.0 as median,
       round(avg(v) + 1e-8, 6) + 0.0 as mean, round(quantile_cont(v, 0.75) + 1e-8, 6) + 0.0 as q3, max(v) as max,
       cast(sum(case when v is null then 1 else 0 end) as bigint) as n_missing from l group by "column" """)
def a12(spark, sf):
    return r6(summary.profile(X.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))


@check("a12_level_counts", """select 'l_returnflag' as "column", l_returnflag as level, count(*) as n from lineitem group by 2
union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2""")
def a12b(spark, sf):
    return summary.level_counts(X.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@check("a13_histogram", """with m as (select m.*, w.gf, w.treatment from modelled m join wide w on m.date = w.date and m.well = w.well),
e as (select gf, min(rmse) as lo, max(rmse) as hi from m group by gf)
select gf, treatment, cast(case when hi = lo then 1 else least(floor((rmse - lo) * 30 / (hi - lo)), 29) + 1 end as integer) as bin, count(*) as n
from m join e using (gf) group by gf, treatment, bin""", "readings wide modelled")
def a13(spark, sf):
    from platewise.operators import joins
    m = joins.annotate(X.modelled(spark, sf), joins.widen_annotations(X.annotations(spark, sf)))
    return summary.histogram(m, "rmse", ["gf"], ["treatment"])


@check("a14_distinct_doses", f"with {NUMBERED} select distinct gf, conc, dose from a", "readings wide")
def a14(spark, sf):
    return summary.distinct_values(numbered(spark, sf), ["gf", "conc"], "dose")


@check("a15_box_stats", f"""with q as (
  select date, freq, param, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3
  from readings group by date, freq, param)
select date, freq, param, {q6('q1')} as q1, {q6('med')} as median, {q6('q3')} as q3,
       min(value) filter (value >= q1 - 1.5 * (q3 - q1)) as lower, max(value) filter (value <= q3 + 1.5 * (q3 - q1)) as upper,
       count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as n_outliers
from readings r join q using (date, freq, param) group by date, freq, param, q1, med, q3""", "readings")
def a15(spark, sf):
    return r6(summary.box_stats(X.readings(spark, sf), ["date", "freq", "param"]))


@check("a16_sample_series", """with k as (select date, well, param from (select distinct date, well, param from readings)
  order by md5(date || '|' || well || '|' || param || '|7'), date, well, param limit 25)
select * from readings where (date, well, param) in (select (date, well, param) from k)""", "readings")
def a16(spark, sf):
    r = X.readings(spark, sf)
    return summary.sample_groups(r, ["date", "well", "param"], 25, seed=7).select(*r.columns)


@check("a16_sample_fraction", """select l_orderkey, l_linenumber, l_returnflag from lineitem
where ('0x' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|1'), 1, 8))::bigint / 4294967296.0::double
      < case l_returnflag when 'A' then 0.05::double when 'R' then 0.5::double else 0 end""")
def a16b(spark, sf):
    df = X.table(spark, sf, "lineitem")
    return summary.sample_fraction(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"A": 0.05, "R": 0.5},
                                   "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@check("a17_single_bin", f"""with t as (select param, cast(floor(time_h) as integer) as time_bin, value from readings)
select param, {q6('avg(value)')} as mean, {q6('stddev_samp(value)')} as sd from t where time_bin = 17 group by param""", "readings")
def a17(spark, sf):
    t = X.readings(spark, sf).withColumn("time_bin", F.floor("time_h").cast("int"))
    return r6(summary.summarise_experiments(summary.single_bin(t, 17), ["param"]).select("param", "mean", "sd"))
