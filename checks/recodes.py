"""Projections, filters and recodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.registry import check, q6, r6
from platewise.functions import numbers, text
from platewise.operators import joins, recode, timeline


def annotated(spark, sf, defaults=None):
    return joins.annotate(X.readings(spark, sf), joins.widen_annotations(X.annotations(spark, sf), defaults=defaults, others=None))


def numbered(spark, sf):
    return recode.numeric_annotations(annotated(spark, sf))


ANNOTATED = "a as (select r.*, w.* exclude (date, well) from readings r join wide w on r.date = w.date and r.well = w.well)"
NUMBERED = ("a as (select r.*, w.gf, w.treatment, w.celldensity, w.serum, try_cast(w.conc_gf as double) as conc, "
            "try_cast(w.doses_treatment as double) as dose from readings r join wide w on r.date = w.date and r.well = w.well)")


@check("p1_select_rename", "select date, well as position, value from readings", "readings")
def p1(spark, sf):
    return X.readings(spark, sf).drop("freq", "param").withColumnRenamed("well", "position").select(
        "date", "position", "value")


@check("p2_equality", "select * from readings where param = 'Z' and freq = 4000", "readings")
def p2(spark, sf):
    return recode.select_readings(X.readings(spark, sf), param="Z", freq=4000)


@check("p3_membership", "select * from readings where param in ('Z', 'C') and freq in (1000, 4000)", "readings")
def p3(spark, sf):
    return recode.select_readings(X.readings(spark, sf), param=["Z", "C"], freq=(1000, 4000))


@check("p4_time_window", "select * from readings where time_h >= 2 and time_h <= 48", "readings")
def p4(spark, sf):
    return timeline.clip_time(X.readings(spark, sf), 2, 48)


@check("p5_exclude_dates", """select * from readings where date <> 'exp3'
  and date <> (select min(date) from readings)""", "readings")
def p5(spark, sf):
    return recode.exclude_first_date(recode.exclude_dates(X.readings(spark, sf), ["exp3"]))


@check("p6_complete_cases", f"with {ANNOTATED} select * from a where serum is not null and value is not null",
       "readings wide")
def p6(spark, sf):
    return recode.complete_cases(annotated(spark, sf))


@check("p7_drop_unbinned", """with t as (select date, time_h, floor(time_h) as f from readings),
last as (select date, max(f) as m from t group by date)
select t.date, t.time_h from t join last on t.date = last.date where t.time_h <= last.m""", "readings")
def p7(spark, sf):
    return timeline.hour_bins(X.readings(spark, sf), ["date"]).where(F.col("time_bin").isNotNull()).select(
        "date", "time_h")


@check("p8_label_filter", "select date, time_h from marks where label like '%GF%'", "marks")
def p8(spark, sf):
    return X.marks(spark, sf).where(F.col("label").rlike("GF")).select("date", "time_h")


@check("p9_drop_constant_columns", f"with {ANNOTATED} select * exclude (celldensity) from a where celldensity = '5000'",
       "readings wide")
def p9(spark, sf):
    return recode.drop_constant_columns(annotated(spark, sf).where(F.col("celldensity") == "5000"))


@check("p10_effective_doses_v1", f"""with {NUMBERED} select date, well, time_h, ceil(dose) as dose from a
  where dose = 0 or dose > 1000""", "readings wide")
def p10(spark, sf):
    return recode.effective_doses(numbered(spark, sf)).select("date", "well", "time_h", "dose")


# Doses from 0 to 200: those of 1 to 100 below the threshold go, 49.975 is rounded up to 50 first and goes as well.
@check("p10_effective_doses_low", f"""with {NUMBERED}, b as (select date, well, time_h, dose / 20 as dose from a)
select date, well, time_h, ceil(dose) as dose from b where ceil(dose) = 0 or ceil(dose) > 50""", "readings wide")
def p10c(spark, sf):
    low = numbered(spark, sf).withColumn("dose", F.col("dose") / 20)
    return recode.effective_doses(low, min_dose=50, ceil_first=True).select("date", "well", "time_h", "dose")


@check("p10_effective_doses_v2", f"""with {NUMBERED} select date, well, time_h, ceil(dose) as dose from a
  where ceil(dose) = 0 or ceil(dose) > 100""", "readings wide")
def p10b(spark, sf):
    return recode.effective_doses(numbered(spark, sf), min_dose=100, ceil_first=True).select(
        "date", "well", "time_h", "dose")


@check("p11_text_to_number", "select date, well, layer, try_cast(value as double) as number from annotations", "annotations")
def p11(spark, sf):
    return X.annotations(spark, sf).select("date", "well", "layer", text.to_number("value").alias("number"))


@check("p12_recode", """select date, well, case value when 'SCR' then 'siNTP' else value end as treatment
  from annotations where layer = 'treatment'""", "annotations")
def p12(spark, sf):
    t = X.annotations(spark, sf).where(F.col("layer") == "treatment").select(
        "date", "well", F.col("value").alias("treatment"))
    return recode.recode(t, "treatment", recode.TREATMENT_RENAMES)


@check("p13_relevel", f"""with {ANNOTATED}
select date, well, time_h, case gf when 'FBS_5' then '5% FBS' when 'VEGF' then 'VEGF' when 'bFGF' then 'FGF2' end as gf,
       cast(case gf when 'FBS_5' then 1 when 'VEGF' then 3 when 'bFGF' then 4 end as integer) as gf_ord,
       case treatment when 'siCD44' then 'siCD44' end as treatment,
       cast(case treatment when 'siCD44' then 2 end as integer) as treatment_ord,
       freq || ' Hz' as freq, freq as freq_ord
from a""", "readings wide")
def p13(spark, sf):
    df = recode.relevel(annotated(spark, sf), "gf", list(recode.GF_LABELS), recode.GF_LABELS)
    df = recode.unit_labels(recode.relevel(df, "treatment", recode.SIRNA_LEVELS), "freq", "Hz")
    return df.select("date", "well", "time_h", "gf", "gf_ord", "treatment", "treatment_ord", "freq", "freq_ord")


@check("p14_mark_untreated", f"""with {NUMBERED} select date, well, time_h,
  case when dose > 0 then treatment else 'untreated' end as treatment from a""", "readings wide")
def p14(spark, sf):
    return recode.mark_untreated(numbered(spark, sf)).select("date", "well", "time_h", "treatment")


@check("p15_comparison_label", rf"""with {NUMBERED}, t as (
  select date, well, time_h, regexp_replace(cast(dose as varchar), '\.0$', '') || ' ng/ml ' || gf || chr(10) || '+' || treatment as l from a)
select date, well, time_h, replace(l, 'SB101', '3MUT') as label_v1,
       replace(replace(l, 'SB101', '3MUT'), 'hIgG', 'rhIgG') as label_v2 from t""", "readings wide")
def p15(spark, sf):
    return numbered(spark, sf).select(
        "date", "well", "time_h",
        text.comparison_label("dose", "gf", "treatment", recode.LABEL_RENAMES_V1).alias("label_v1"),
        text.comparison_label("dose", "gf", "treatment", recode.LABEL_RENAMES_V2).alias("label_v2"))


@check("p16_legend_and_group_labels", rf"""with {NUMBERED}, g as (
  select date, gf, conc, row_number() over (partition by date order by conc) as i, count(*) over (partition by date) as n
  from (select distinct date, gf, conc from a)), gl as (
  select date, gf || '-' || regexp_replace(cast(conc as varchar), '\.0$', '') as group_label from g where i = least(2, n))
select distinct a.date, well, regexp_replace(cast(conc as varchar), '\.0$', '') || '-' || gf || '-' || treatment as legend,
       group_label from a join gl on a.date = gl.date""", "readings wide")
def p16(spark, sf):
    df = numbered(spark, sf)
    labels = recode.group_label(df, ["date"])
    return joins.attach(df, labels, ["date"]).select(
        "date", "well", recode.legend_label("conc", "gf", "treatment").alias("legend"), "group_label").distinct()


@check("p17_unlog", """select l_orderkey, l_linenumber, cast(floor(round(pow(10, log10(l_quantity)), 9)) as bigint) as conc
  from lineitem""")
def p17(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.unlog(F.log10("l_quantity")).alias("conc"))


@check("p18_pool_values", """select l_orderkey, l_linenumber,
  cast(case when l_quantity in (1, 2, 3) then 3 when l_quantity in (5, 6, 7) then 7 when l_quantity in (12, 15) then 15
            when l_quantity in (19, 25, 39) then 25 when l_quantity in (50, 63, 79) then 63 else l_quantity end as double) as conc
  from lineitem""")
def p18(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numbers.pool_values("l_quantity", numbers.POOL_HGF_FGF).cast("double").alias("conc"))


@check("p19_dose_bins", """with b as (select * from (values (0, 1, '[0,1]'), (1, 128, '(1,128]'), (128, 402, '(128,402]'),
  (402, 1267, '(402,1.27e+03]'), (1267, 4001, '(1.27e+03,4e+03]'), (4001, 8001, '(4e+03,8e+03]'),
  (8001, 12641, '(8e+03,1.26e+04]'), (12641, 16001, '(1.26e+04,1.6e+04]')) t(lo, hi, name))
select l_orderkey, l_linenumber,
       (select name from b where (l_extendedprice > lo or (lo = 0 and l_extendedprice = 0)) and l_extendedprice <= hi) as dose_bin
from lineitem""")
def p19(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numbers.cut_breaks("l_extendedprice", numbers.DOSE_BREAKS, include_lowest=True).alias("dose_bin"))


@check("p20_micromolar", """with t as (select l_orderkey, l_linenumber, floor(l_extendedprice) / 1000 as x from lineitem)
select l_orderkey, l_linenumber,
       (select c from (values (floor(x * 100) / 100, floor(x * 100) % 2), (ceil(x * 100) / 100, ceil(x * 100) % 2)) v(c, odd)
        order by abs(x - c), odd limit 1) as dose from t""")
def p20(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.to_micromolar(F.floor("l_extendedprice").cast("double")).alias("dose"))


@check("p21_param_info", f"""select param,
  case param when 'Z' then 'impedance' when 'R' then 'resistance' when 'C' then 'capacitance'
             when 'Rb' then 'barrier resistance' else 'alpha' end as param_name,
  case param when 'Z' then 'Ohm' when 'R' then 'Ohm' when 'C' then 'F' when 'Rb' then 'Ohm.cm^2' else 'Ohm^0.5.cm' end as unit,
  count(*) as n, {q6('avg(value)')} as mean from readings group by param""", "readings")
def p21(spark, sf):
    per = X.readings(spark, sf).groupBy("param").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return r6(recode.with_param_info(per))


@check("p22_serum_subset", f"with {ANNOTATED} select * exclude (serum) from a where serum = 'FBS'", "readings wide")
def p22(spark, sf):
    return annotated(spark, sf).where(F.col("serum") == "FBS").drop("serum")


@check("p23_parse_date", """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as full_date,
  case when o_orderdate >= '2000-01-01' then strftime(o_orderdate, '%Y-%m-%d')
       else '20' || strftime(o_orderdate, '%y-%m-%d') end as short_date,
  try_cast(null as varchar) as bad from orders""")
def p23(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", text.parse_date(day).cast("string").alias("full_date"),
        text.parse_date(F.substring(day, 3, 6)).cast("string").alias("short_date"),
        text.parse_date("o_orderpriority").cast("string").alias("bad"))
