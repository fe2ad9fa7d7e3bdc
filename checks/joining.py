"""Joins and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.recodes import ANNOTATED, NUMBERED, annotated, numbered
from checks.registry import check, q6, r6
from platewise.operators import joins, recode, summary, timeline


@check("j1_readings_with_annotations", f"with {ANNOTATED} select * from a", "readings wide")
def j1(spark, sf):
    return annotated(spark, sf)


@check("j2_modelled_with_annotations", """select m.*, w.* exclude (date, well) from modelled m
  join wide w on m.date = w.date and m.well = w.well where w.celldensity = '5000'""", "readings wide modelled")
def j2(spark, sf):
    wide = joins.widen_annotations(X.annotations(spark, sf), others=None).where(F.col("celldensity") == "5000")
    return joins.annotate(X.modelled(spark, sf), wide)


def _all_layers(spark, sf):
    return joins.widen_annotations(X.more_annotations(spark, sf))


def _others_as_text(df):
    """The map of other layers as sorted text, which both engines write alike."""
    return df.withColumn("others", F.array_join(F.array_sort(F.transform(
        F.map_entries("others"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


@check("j1_readings_with_all_layers", """select r.*, w.* exclude (date, well), coalesce(o.others, '') as others from readings r
  join wide w on r.date = w.date and r.well = w.well left join others o on r.date = o.date and r.well = o.well""",
       "readings wide others")
def j1b(spark, sf):
    return _others_as_text(joins.annotate(X.readings(spark, sf), _all_layers(spark, sf)))


@check("j2_modelled_with_all_layers", """select m.*, w.* exclude (date, well), coalesce(o.others, '') as others from modelled m
  join wide w on m.date = w.date and m.well = w.well left join others o on m.date = o.date and m.well = o.well
  where w.celldensity = '5000'""", "readings wide others modelled")
def j2b(spark, sf):
    return _others_as_text(joins.annotate(X.modelled(spark, sf), _all_layers(spark, sf).where(F.col("celldensity") == "5000")))


@check("j1_readings_with_spread_layers", """select r.*, w.* exclude (date, well), p.passage, m.medium from readings r
  join wide w on r.date = w.date and r.well = w.well
  left join (select date, well, 'P' || cast(w % 4 + 3 as varchar) as passage from units where d % 2 = 1) p on r.date = p.date and r.well = p.well
  left join (select date, well, 'M199' as medium from units where w % 2 = 0) m on r.date = m.date and r.well = m.well""",
       "readings wide")
def j1c(spark, sf):
    return joins.spread_layers(joins.annotate(X.readings(spark, sf), _all_layers(spark, sf)), "passage", "medium")


@check("j3_semi_join_by_annotation", """select * from readings where date in
  (select date from annotations where value = 'FBS')""", "readings annotations")
def j3(spark, sf):
    return joins.keep_dates(X.readings(spark, sf), joins.dates_with(X.annotations(spark, sf), "FBS"))


@check("j4_left_natural_join", """select r.*, w.treatment, w.gf from readings r left join
  (select * from wide where celldensity = '10000') w on r.date = w.date and r.well = w.well""", "readings wide")
def j4(spark, sf):
    wide = joins.widen_annotations(X.annotations(spark, sf)).where(F.col("celldensity") == "10000")
    return joins.natural_join(X.readings(spark, sf), wide.select("date", "well", "treatment", "gf"))


@check("j5_left_join_marks", """select r.date, r.time_h, m.time_h as mark_h from readings r
  left join marks m on r.date = m.date""", "readings marks")
def j5(spark, sf):
    m = X.marks(spark, sf).select("date", F.col("time_h").alias("mark_h"))
    return joins.attach(X.readings(spark, sf).select("date", "time_h"), m, ["date"], "left")


@check("j5_left_join_all_marks", """select r.date, r.time_h, m.label, m.time_h as mark_h from readings r
  left join marks m on r.date = m.date""", "readings marks")
def j5b(spark, sf):
    m = X.marks(spark, sf).select("date", "label", F.col("time_h").alias("mark_h"))
    return joins.attach(X.readings(spark, sf).select("date", "time_h"), m, ["date"], "left")


@check("j6_merge_release", """select r.date, r.time_h, m.h as mark_h from readings r
  join (select date, max(time_h) as h from marks group by date) m on r.date = m.date""", "readings marks")
def j6(spark, sf):
    release = timeline.release_time(X.marks(spark, sf))
    return joins.natural_join(X.readings(spark, sf).select("date", "time_h"), release, "inner", null_safe=False)


@check("j7_replicated_series", f"""with {NUMBERED}
select date, well, time_h, gf, conc, treatment from a where (gf, conc, treatment) in
  (select (gf, conc, treatment) from a group by gf, conc, treatment having count(distinct date) >= 4)""", "readings wide")
def j7(spark, sf):
    df = numbered(spark, sf).select("date", "well", "time_h", "gf", "conc", "treatment")
    return joins.replicated_series(df, ["gf", "conc", "treatment"], min_n=4).select(
        "date", "well", "time_h", "gf", "conc", "treatment")


_MEANS = f"""{NUMBERED}, m as (
  select gf, date, conc, dose, treatment, {q6('avg(value)')} as value from a group by gf, date, conc, dose, treatment),
g as (select gf, min(conc) as ctrl, count(distinct conc) as n from m group by gf),
i as (select distinct gf, conc as pair_ind from m),
pr as (select m.*, i.pair_ind from m join g on m.gf = g.gf join i on i.gf = m.gf
       where (g.n = 1) or (i.pair_ind <> g.ctrl and (m.conc = g.ctrl or m.conc = i.pair_ind)))"""


def _means(spark, sf):
    return r6(summary.mean_by(numbered(spark, sf), ["gf", "date", "conc", "dose", "treatment"]))


@check("j8_pairs", f"with {_MEANS} select * from pr", "readings wide")
def j8(spark, sf):
    return joins.pairs(_means(spark, sf), ["gf"])


@check("j8_pairs_by_date", f"""with {NUMBERED}, m as (
  select date, gf, param, conc, {q6('avg(value)')} as value from a group by date, gf, param, conc),
g as (select date, gf, param, min(conc) as ctrl, count(distinct conc) as n from m group by date, gf, param)
select m.*, x.conc as pair_ind from m join g using (date, gf, param) join m x using (date, gf, param)
where g.n = 1 or (x.conc <> g.ctrl and m.conc in (g.ctrl, x.conc))""", "readings wide")
def j8b(spark, sf):
    means = r6(summary.mean_by(numbered(spark, sf), ["date", "gf", "param", "conc"]))
    return joins.pairs(means, ["date", "gf", "param"])


@check("j9_dates_with_treated", f"""with {_MEANS} select * from pr p where exists (
  select 1 from pr q where q.gf = p.gf and q.pair_ind = p.pair_ind and q.date = p.date and q.value > 62)""", "readings wide")
def j9(spark, sf):
    paired = joins.pairs(_means(spark, sf), ["gf"]).withColumn("over", F.col("value") - 62)
    return joins.dates_with_treated(paired, ["gf", "pair_ind"], "over").drop("over")


@check("j10_regroup_pairs", f"""with {NUMBERED}, k as (
  select date, gf, min(conc) as ctrl, count(distinct conc) as n from a group by date, gf),
i as (select distinct date, gf, conc as pair_ind from a),
pr as (select a.*, i.pair_ind from a join k using (date, gf) join i using (date, gf)
       where k.n = 1 or (i.pair_ind <> k.ctrl and a.conc in (k.ctrl, i.pair_ind)))
select gf, pair_ind, count(distinct date) as n_dates, count(*) as n, {q6('avg(value)')} as mean from pr
group by gf, pair_ind""", "readings wide")
def j10(spark, sf):
    paired = joins.pairs(numbered(spark, sf).select("date", "gf", "conc", "value"), ["date", "gf"])
    return r6(paired.groupBy("gf", "pair_ind").agg(
        F.count_distinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@check("j11_hourly_means_with_treatments", f"""with f as (select distinct floor(time_h) as f from readings), b as (
  select r.*, (select count(*) from f where f.f < r.time_h) as bin, (select count(*) from f where f.f >= r.time_h) as later
  from readings r), h as (
  select date, well, param, cast(bin as integer) as time_bin, {q6('avg(value)')} as value from b
  where later > 0 group by date, well, param, bin)
select h.*, w.* exclude (date, well) from h join wide w on h.date = w.date and h.well = w.well""", "readings wide")
def j11(spark, sf):
    from platewise.plans.figures import hourly_well_means
    return r6(hourly_well_means(X.readings(spark, sf), X.annotations(spark, sf), others=None))


@check("j12_keyed_lookup", f"with {ANNOTATED} select * from a where celldensity = '5000' and gf = 'VEGF'", "readings wide")
def j12(spark, sf):
    return recode.select_readings(annotated(spark, sf), celldensity="5000", gf="VEGF")


@check("j13_merge_by_well", """select r.date, r.well, r.value, s.n from readings r
  join (select well, count(*) as n from readings group by well) s on r.well = s.well""", "readings")
def j13(spark, sf):
    r = X.readings(spark, sf)
    sizes = r.groupBy("well").agg(F.count(F.lit(1)).alias("n"))
    return joins.attach(r.select("date", "well", "value"), sizes, ["well"])


@check("j14_range_assignment", "select date, time_h, value, mark as label from phased where mark is not null",
       "readings marks phased")
def j14(spark, sf):
    df = X.readings(spark, sf).select("date", "time_h", "value")
    return joins.assign_ranges(df, timeline.mark_ranges(X.marks(spark, sf)), ["date"], "time_h")


# From half an hour before each mark to two hours after it, and from the start of all recordings to each mark: no key.
_SPANS = """spans as (select date || ' ' || label as span, time_h - 0.5 as lo, time_h + 2 as hi from marks
  union all select date || ' before ' || label, '-inf'::double, time_h from marks)"""


@check("j14_overlapping_ranges", f"""with {_SPANS} select span, param, count(*) as n, {q6('sum(value)')} as total
from readings r join spans s on s.lo < r.time_h and r.time_h <= s.hi group by span, param""", "readings marks")
def j14b(spark, sf):
    m = X.marks(spark, sf)
    name, t = F.concat("date", F.lit(" "), "label"), F.col("time_h")
    around = m.select(name.alias("span"), (t - 0.5).alias("lo"), (t + 2).alias("hi"))
    before = m.select(F.concat("date", F.lit(" before "), "label").alias("span"), F.lit(float("-inf")).alias("lo"), t.alias("hi"))
    joined = joins.overlap_join(X.readings(spark, sf).select("param", "time_h", "value"), around.unionByName(before), "time_h")
    return r6(joined.groupBy("span", "param").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))
