"""Time alignment, bins, normalisation and per-series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.registry import check, q6, r6
from platewise.operators import diagnostics, joins, normalise, rows, timeline
from platewise.schema import MODEL_SERIES, SERIES, WELL


@check("w1_rebase_to_start", f"""select r.* exclude (time_h), {q6('time_h - (select min(time_h) from readings x where x.date = r.date)')} as time_h
  from readings r""", "readings")
def w1(spark, sf):
    return r6(timeline.rebase_to_start(X.readings(spark, sf)))


@check("w2_rebase_to_mark", f"""select r.* exclude (time_h), {q6('r.time_h - m.h')} as time_h from readings r
  join (select date, max(time_h) as h from marks group by date) m on r.date = m.date""", "readings marks")
def w2(spark, sf):
    return r6(timeline.rebase_to_mark(X.readings(spark, sf), timeline.release_time(X.marks(spark, sf))))


def _bins_sql(by: str, out: str, t: str = "time_h") -> str:
    """Bins by counting: a time lies in bin i when i breaks lie strictly below it (one at least, for the lowest
    break) and at least one break lies at or above it; the label is the smallest break at or above it, or above
    the lowest one."""
    on = " and ".join(f"f.{k} = r.{k}" for k in by.split()) if by else "true"
    keys = ", ".join(by.split()) + ", " if by else ""
    bin_ = (f"cast(greatest((select count(*) from f where {on} and f.f < r.{t}), 1) as integer)" if out == "ordinal" else
            f"cast((select min(f.f) from f where {on} and f.f >= r.{t} and f.f > (select min(f) from f where {on})) as integer)")
    return f"""with f as (select distinct {keys} floor({t}) as f from src), n as (
  select src.*, row_number() over () as id from src)
select r.* exclude (id), case when (select count(*) from f where {on}) > 1 and r.{t} <= (select max(f.f) from f where {on})
       then {bin_} end as time_bin from n r"""


_WHOLE = """(select * from readings union all
  select date, well, param, freq, floor(time_h) as time_h, value from readings where value > 100)"""


def _with_whole_hours(spark, sf):
    """Readings, and some again at whole hours, so that times on break points occur."""
    r = X.readings(spark, sf)
    return r.unionByName(r.where(F.col("value") > 100).withColumn("time_h", F.floor("time_h").cast("double")))


def _bins_check(name: str, by: tuple, out: str):
    sql = _bins_sql(" ".join(by), out)
    sql = sql.replace("with f as", f"with src as {_WHOLE}, f as", 1)

    @check(name, sql, "readings")
    def run(spark, sf):
        return timeline.hour_bins(_with_whole_hours(spark, sf), by, out=out)
    return run


_bins_check("w3_hour_bins_by_date", ("date",), "ordinal")
_bins_check("w3_hour_bins_by_well", ("date", "well"), "ordinal")
_bins_check("w3_hour_bins_by_series", SERIES, "ordinal")
_bins_check("w3_hour_bins_all_rows", (), "ordinal")
_bins_check("w4_hour_bin_labels_by_date", ("date",), "label")
_bins_check("w4_hour_bin_labels_by_well", ("date", "well"), "label")


def _relative(name: str, how: str, base: str, divide: bool, by: tuple = MODEL_SERIES):
    keys = ", ".join(by)
    value = q6("value / nullif(base, 0)") if divide else q6("value - base")
    sql = f"""with o as (
  select *, row_number() over (partition by {keys} order by time_h) as i,
         row_number() over (partition by {keys} order by time_h desc) as j from readings), b as (
  select {keys}, {base} as base from o group by {keys})
select o.* exclude (i, j, value), {value} as value from o join b using ({keys})"""

    @check(name, sql, "readings")
    def run(spark, sf):
        return r6(normalise.normalise(X.readings(spark, sf), by, how), only=("value",))
    return run


_relative("w5_divide_by_first", "div_first", "max(value) filter (i = 1)", True)
_relative("w5_divide_by_first_of_well", "div_first", "max(value) filter (i = 1)", True, ("well", "freq"))
_relative("w6_subtract_first", "sub_first", "max(value) filter (i = 1)", False)
_relative("w7_divide_by_head_mean", "div_head", "avg(value) filter (i <= 3)", True)
_relative("w7_divide_by_head_mean_short", "div_head", "avg(value) filter (i <= 3)", True, SERIES)
_relative("w8_subtract_head_mean", "sub_head", "avg(value) filter (i <= 3)", False)
_relative("w10_divide_by_tail_mean", "div_tail", "avg(value) filter (j <= 3)", True)


@check("w8_subtract_recycled_head", f"""with o as (
  select *, row_number() over (partition by date, well, param order by time_h) as i from readings)
select o.* exclude (i, value), {q6('o.value - h.value')} as value from o join o h
  on o.date = h.date and o.well = h.well and o.param = h.param and h.i = (o.i - 1) % 3 + 1""", "readings")
def w8b(spark, sf):
    return r6(normalise.normalise(X.readings(spark, sf), MODEL_SERIES, "sub_recycled"), only=("value",))


@check("w9_divide_by_bin_mean", f"""with t as (select *, cast(floor(time_h) as integer) as time_bin from readings),
b as (select date, well, avg(value) as base from t where time_bin = 24 group by date, well)
select t.* exclude (value), {q6('value / nullif(base, 0)')} as value from t left join b using (date, well)""", "readings")
def w9(spark, sf):
    t = X.readings(spark, sf).withColumn("time_bin", F.floor("time_h").cast("int"))
    return r6(normalise.normalise(t, WELL, "div_bin", at=24), only=("value",))


@check("w11_minmax", f"""select * exclude (value), {q6('(value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0)')} as value
  from readings window w as (partition by date, well, param)""", "readings")
def w11(spark, sf):
    return r6(normalise.normalise(X.readings(spark, sf), MODEL_SERIES, "minmax"), only=("value",))


@check("w12_align_right", """with t as (select date, well, time_h, cast(floor(time_h) as integer) as time_bin from readings)
select date, well, time_h, time_bin - max(time_bin) over (partition by date) as time_bin from t""", "readings")
def w12(spark, sf):
    t = X.readings(spark, sf).select("date", "well", "time_h", F.floor("time_h").cast("int").alias("time_bin"))
    return timeline.align_right(t)


@check("w13_mark_segments", "select * from phased", "readings marks phased")
def w13(spark, sf):
    return timeline.segment_by_marks(X.readings(spark, sf), X.marks(spark, sf))


@check("w13_refused_dates", """select * from (select d.date, count(m.date) as n_marks,
  case count(m.date) when 0 then 'no marks' when 1 then 'fewer than two marks' when 4 then 'more than three marks' else
    case when count(m.time_h) < count(m.date) then 'a mark without a time'
         when count(distinct m.time_h) < count(m.time_h) then 'two marks at one time'
         when min(m.time_h) <= 0 then 'a mark at or before the start' end end as reason
  from (select distinct date from readings) d left join spoiled m on m.date = d.date group by d.date) where reason is not null""",
       "readings marks spoiled")
def w13b(spark, sf):
    return timeline.refused_dates(X.spoiled_marks(spark, sf), X.readings(spark, sf))


# The dates whose marks are not spoiled have their phases; the others are set aside.
@check("w13_segments_of_sound_dates", "select * from phased where date in ('exp0', 'exp3', 'exp8', 'exp9')", "readings marks phased")
def w13c(spark, sf):
    sound = timeline.sound_marks(X.spoiled_marks(spark, sf))
    return timeline.segment_by_marks(X.readings(spark, sf), sound, on_invalid="drop")


@check("w14_common_length", """with t as (select date, well, time_h, cast(floor(time_h * 10) as integer) as time_bin from readings),
c as (select date, count(distinct time_bin) as n from t group by date)
select * from t where time_bin <= (select min(n) from c)""", "readings")
def w14(spark, sf):
    t = X.readings(spark, sf).select("date", "well", "time_h", F.floor(F.col("time_h") * 10).cast("int").alias("time_bin"))
    return timeline.common_length(t)


_LAG = """o as (select *, lag(value) over (partition by date, well, param order by time_h) as p,
  row_number() over (partition by date, well, param order by time_h) as i from readings)"""
_FIT = """fit as (select date, well, param, regr_slope(value, p) as phi, regr_intercept(value, p) as c,
  regr_count(value, p) as n, regr_syy(value, p) as syy, regr_sxy(value, p) as sxy from o where p is not null
  group by date, well, param)"""


@check("row_numbers", """select date, well, param, time_h,
  row_number() over (partition by date, well, param order by time_h) as rn from readings""", "readings")
def row_numbers(spark, sf):
    return rows.number_rows(X.readings(spark, sf).select("date", "well", "param", "time_h"), MODEL_SERIES)


@check("t1_ar1_fit", f"""with {_LAG}, {_FIT} select date, well, param, {q6('phi')} as phi, {q6('c')} as intercept,
  {q6('(syy - phi * sxy) / n')} as sigma2, cast(n as bigint) as n from fit""", "readings")
def t1(spark, sf):
    return r6(diagnostics.ar1_fit(X.readings(spark, sf), MODEL_SERIES))


@check("t2_autocorrelation", f"""with m as (select *, value - avg(value) over w as d,
  row_number() over (w order by time_h) as i from readings window w as (partition by date, well, param)),
s as (select date, well, param, sum(d * d) as s0, count(*) as n from m group by date, well, param),
k as (select unnest([1, 2, 3]) as lag),
g as (select a.date, a.well, a.param, b.i - a.i as lag, sum(a.d * b.d) as g from m a join m b
  on a.date = b.date and a.well = b.well and a.param = b.param and b.i - a.i between 1 and 3 group by all)
select s.date, s.well, s.param, cast(k.lag as integer) as lag, {q6('coalesce(g.g, 0) / nullif(s0, 0)')} as r, n
from s cross join k left join g on g.date = s.date and g.well = s.well and g.param = s.param and g.lag = k.lag""", "readings")
def t2(spark, sf):
    return r6(diagnostics.autocorrelation(X.readings(spark, sf), MODEL_SERIES, 3))


_RESIDUALS = f"""{_LAG}, {_FIT}, res as (select o.date, o.well, o.param, time_h, value - c - phi * p as residual
  from o join fit on o.date = fit.date and o.well = fit.well and o.param = fit.param where p is not null)"""


@check("t3_box_pierce", f"""with {_RESIDUALS}, m as (select *, residual - avg(residual) over w as d,
  row_number() over (w order by time_h) as i from res where residual is not null window w as (partition by date, well, param)),
s as (select date, well, param, sum(d * d) as s0, count(*) as n from m group by date, well, param),
g as (select a.date, a.well, a.param, sum(a.d * b.d) as g from m a join m b
  on a.date = b.date and a.well = b.well and a.param = b.param and b.i = a.i + 1 group by all)
select date, well, param, case when n > 3 then {q6('n * pow(coalesce(g, 0) / nullif(s0, 0), 2)')} end as q, n
from s left join g using (date, well, param)""", "readings")
def t3(spark, sf):
    residuals = diagnostics.ar1_residuals(X.readings(spark, sf), MODEL_SERIES)
    # Shorter series leave residuals that are zero but for rounding, whose correlation means nothing: theirs is missing.
    return r6(diagnostics.box_pierce(residuals, MODEL_SERIES, min_n=4))


@check("t3_box_pierce_all_series", f"""with {_RESIDUALS}, m as (select *, residual - avg(residual) over w as d,
  row_number() over (w order by time_h) as i from res where residual is not null window w as (partition by date, well, param)),
s as (select date, well, param, sum(d * d) as s0, count(*) as n from m group by date, well, param),
g as (select a.date, a.well, a.param, sum(a.d * b.d) as g from m a join m b
  on a.date = b.date and a.well = b.well and a.param = b.param and b.i = a.i + 1 group by all)
select k.date, k.well, k.param, case when n > 3 then {q6('n * pow(coalesce(g, 0) / nullif(s0, 0), 2)')} end as q,
  coalesce(n, 0) as n
from (select distinct date, well, param from readings) k left join s using (date, well, param)
left join g using (date, well, param)""", "readings")
def t3b(spark, sf):
    r = X.readings(spark, sf)
    found = diagnostics.box_pierce(diagnostics.ar1_residuals(r, MODEL_SERIES), MODEL_SERIES, min_n=4)
    whole = joins.attach(r.select(*MODEL_SERIES).distinct(), found, MODEL_SERIES, "left", null_safe=True)
    return r6(whole.na.fill(0, ["n"]))


# erfc(sqrt(q / 2)) as one less the series 2 z / sqrt(pi) e^(-z^2) sum (2 z^2)^n / (2n + 1)!!, z^2 = q / 2.
_ERFC = """case when q = 0 then 1.0 when q > 0 then 1 - exp(-q / 2) * sqrt(2 * q) * list_sum(list_transform(range(0, 400),
  lambda n: exp(n * ln(q) - (n + 1) * ln(2) - lgamma(n + 1.5)))) end"""


@check("t3_box_test", f"""with {_RESIDUALS}, m as (select *, residual - avg(residual) over w as d,
  row_number() over (w order by time_h) as i from res where residual is not null window w as (partition by date, well, param)),
s as (select date, well, param, sum(d * d) as s0, count(*) as n from m group by date, well, param),
g as (select a.date, a.well, a.param, sum(a.d * b.d) as g from m a join m b
  on a.date = b.date and a.well = b.well and a.param = b.param and b.i = a.i + 1 group by all),
t as (select date, well, param, case when n > 3 then n * pow(coalesce(g, 0) / nullif(s0, 0), 2) end as q, n
  from s left join g using (date, well, param))
select date, well, param, {q6('q')} as q, n, {q6(_ERFC)} as p_value from t""", "readings")
def t3c(spark, sf):
    residuals = diagnostics.ar1_residuals(X.readings(spark, sf), MODEL_SERIES)
    return r6(diagnostics.box_test(residuals, MODEL_SERIES, min_n=4))


@check("t4_linear_trend", f"""select date, well, param, {q6('regr_slope(value, time_h)')} as slope,
  {q6('regr_intercept(value, time_h)')} as intercept, {q6('regr_r2(value, time_h)')} as r2,
  cast(regr_count(value, time_h) as bigint) as n from readings group by date, well, param""", "readings")
def t4(spark, sf):
    return r6(diagnostics.linear_trend(X.readings(spark, sf), MODEL_SERIES))


@check("t5_ar1_residuals", f"""with {_RESIDUALS} select date, well, param, {q6('time_h')} as time_h,
  {q6('residual')} as residual from res""", "readings")
def t5(spark, sf):
    return r6(diagnostics.ar1_residuals(X.readings(spark, sf), MODEL_SERIES))
