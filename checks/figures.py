"""The figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.registry import check, q6, r6
from platewise.functions import numbers
from platewise.plans import figures
from platewise.operators.classify import dates_of_class
from platewise.operators.joins import widen_annotations


def _inputs(spark, sf):
    return X.readings(spark, sf), X.annotations(spark, sf), X.marks(spark, sf)


BASE = "readings wide marks phased ann"


def bins(src: str, by: str, t: str, out: str, name: str = "binned", extra: str | None = None) -> str:
    """CTEs that add time_bin to `src` by counting breaks; breaks come from `extra` where given."""
    on = " and ".join(f"f.{k} = r.{k}" for k in by.split()) if by else "true"
    keys = "".join(k + ", " for k in by.split())
    pick = (f"cast(greatest((select count(*) from {name}_f f where {on} and f.f < r.{t}), 1) as integer)" if out == "ordinal"
            else f"cast((select min(f.f) from {name}_f f where {on} and f.f >= r.{t} and f.f > (select min(f) from {name}_f f where {on})) as integer)")
    return f"""{name}_f as (select distinct {keys}floor({t}) as f from {extra or src} where {t} is not null),
{name}_t as (select distinct {keys}{t} from {src}), {name}_b as (
  select r.*, case when (select count(*) from {name}_f f where {on}) > 1 and r.{t} <= (select max(f.f) from {name}_f f where {on})
              then {pick} end as time_bin from {name}_t r),
{name} as (select s.*, b.time_bin from {src} s left join {name}_b b using ({keys}{t}))"""


def pairs(src: str, by: str, name: str = "pr") -> str:
    """CTEs that repeat `src` once per control/induced pair."""
    keys = ", ".join(by.split())
    return f"""{name}_c as (select {keys}, min(conc) as ctrl, count(distinct conc) as nc from {src} group by {keys}),
{name}_i as (select distinct {keys}, conc as pair_ind from {src}),
{name} as (select m.*, pair_ind from {src} m join {name}_c using ({keys}) join {name}_i using ({keys})
  where nc = 1 or (pair_ind <> ctrl and conc in (ctrl, pair_ind)))"""


def treated(src: str, name: str = "tr") -> str:
    return f"""{name} as (select * from {src} p where exists (select 1 from {src} q
  where q.gf = p.gf and q.pair_ind = p.pair_ind and q.date = p.date and q.dose > 0))"""


def labels(src: str, version: int, name: str = "lab") -> str:
    text = r"regexp_replace(cast(conc as varchar), '\.0$', '') || ' ng/ml ' || gf || chr(10) || '+' || (case when dose > 0 then treatment else 'untreated' end)"
    text = f"replace({text}, 'SB101', '3MUT')"
    if version == 2:
        text = f"replace({text}, 'hIgG', 'rhIgG')"
    return f"{name} as (select *, {text} as treat2 from {src})"


def mean_se(src: str, keys: str, value: str = "value") -> str:
    se = f"stddev_samp({value}) / sqrt(count({value}))"
    return (f"select {keys}, {q6(f'avg({value})')} as y, {q6(f'avg({value}) - {se}')} as y_min, "
            f"{q6(f'avg({value}) + {se}')} as y_max from {src} group by {keys}")


def spread(src: str, keys: str, value: str = "value") -> str:
    """mean, sd, n, se; missing as soon as one value is."""
    whole = f"count({value}) = count(*)"
    return (f"select {keys}, case when {whole} then {q6(f'avg({value})')} end as mean, "
            f"case when {whole} then {q6(f'stddev_samp({value})')} end as sd, count(*) as n, "
            f"case when {whole} then {q6(f'stddev_samp({value}) / sqrt(count(*))')} end as se from {src} group by {keys}")


def strict_avg(v: str) -> str:
    return f"case when count({v}) = count(*) then avg({v}) end"


def head_base(src: str, by: str, n: int = 3, desc: bool = False, t: str = "t", name: str = "hb") -> str:
    """(by, base): mean of the first (last) n values."""
    return f"""{name} as (select {by}, {strict_avg('value')} as base from (
  select *, row_number() over (partition by {by} order by {t} {'desc' if desc else ''}) as i from {src}) where i <= {n} group by {by})"""


# --- after release ------------------------------------------------------------------------------------

# The class of experiments that silencing figures are about.
_SILENCING = "date in (select date from annotations where value = 'siCD44')"

_AFTER = """r0 as (select *, time_h - min(time_h) over (partition by date) as t from rel where {where}),
s as (select * exclude (dose), ceil(dose) as dose from r0 where t <= 36 and (dose = 0 or dose > 1000) and date <> 'exp9')"""


def _paired_sql(where: str, series: str) -> str:
    return f"""with {_AFTER.format(where=where)}, {head_base('s', series)},
v as (select s.*, value / nullif(base, 0) as x from s join hb using ({series})),
{bins('v', series.replace(',', ''), 't', 'ordinal')},
m as (select freq, param, date, conc, dose, gf, treatment, time_bin, {strict_avg('x')} as value from binned
      where time_bin is not null group by freq, param, date, conc, dose, gf, treatment, time_bin),
{labels('m', 1)}, {pairs('lab', 'gf')}, {treated('pr')} """


@check("q1_release_summary", _paired_sql("param = 'Z' and freq = 4000", "date, well")
       + spread("tr", "freq, param, gf, pair_ind, conc, dose, time_bin, treat2"), BASE + " rel")
def q1(spark, sf):
    return r6(figures.release_summary(*_inputs(spark, sf), param="Z", freq=4000, max_time=36, exclude=["exp9"]))


@check("q1_release_summary_of_sound_dates",
       _paired_sql("param = 'Z' and freq = 4000 and date in ('exp0', 'exp3', 'exp8')", "date, well")
       + spread("tr", "freq, param, gf, pair_ind, conc, dose, time_bin, treat2"), BASE + " rel")
def q1_sound(spark, sf):
    r, a, _ = _inputs(spark, sf)
    return r6(figures.release_summary(r, a, X.spoiled_marks(spark, sf), param="Z", freq=4000, max_time=36, exclude=["exp9"]))


@check("q1_release_summary_of_carriers", _paired_sql("param = 'Z' and date in (select date from annotations where value = 'siCD44')",
                                                     "date, well, freq")
       + spread("tr", "freq, param, gf, pair_ind, conc, dose, time_bin, treat2"), BASE + " rel")
def q1_carriers(spark, sf):
    return r6(figures.release_summary(*_inputs(spark, sf), param="Z", series=("date", "well", "freq"), max_time=36,
                                      exclude=["exp9"], carrier="siCD44"))


def _with_serum(spark, sf):
    """The class of experiments whose annotations have a serum layer, and no passage."""
    return dates_of_class(X.annotations(spark, sf), having=("serum",), lacking=("passage",))


_SERUM = "(select date from annotations where layer = 'serum')"


@check("q1_release_summary_of_class", _paired_sql(f"param = 'Z' and freq = 4000 and date in {_SERUM}", "date, well")
       + spread("tr", "freq, param, gf, pair_ind, conc, dose, time_bin, treat2"), BASE + " rel")
def q1_class(spark, sf):
    return r6(figures.release_summary(*_inputs(spark, sf), param="Z", freq=4000, max_time=36, exclude=["exp9"],
                                      experiments=_with_serum(spark, sf)))


@check("q5_release_all_frequencies_of_class", _paired_sql(f"date in {_SERUM}", "date, well, param, freq")
       + mean_se("tr", "param, freq, gf, pair_ind, dose, treat2, time_bin"), BASE + " rel")
def q5_class(spark, sf):
    return r6(figures.release_all_frequencies(*_inputs(spark, sf), max_time=36, exclude=["exp9"],
                                              experiments=_with_serum(spark, sf)))


@check("q5_release_all_frequencies", _paired_sql("true", "date, well, param, freq")
       + mean_se("tr", "param, freq, gf, pair_ind, dose, treat2, time_bin"), BASE + " rel")
def q5(spark, sf):
    return r6(figures.release_all_frequencies(*_inputs(spark, sf), max_time=36, exclude=["exp9"]))


@check("q2_pre_release_summary", f"""with {_AFTER.format(where="param = 'Z'")},
lv as (select distinct gf, conc, dose, date from s), {pairs('lv', 'gf')},
dates as (select distinct date from pr where gf = 'VEGF' and pair_ind = 25 and dose > 0),
pre as (select p.* from phased p join ann a on p.date = a.date and p.well = a.well
        where p.mark in ('Seed', 'Starv', 'Preinc') and a.celldensity = '5000' and param = 'Z'),
{bins('pre', '', 'time_h', 'ordinal')},
al as (select * exclude (time_bin), time_bin - max(time_bin) over (partition by date) as time_bin from binned
       where time_bin is not null and date in (select date from dates)),
k as (select * from al where time_bin >= -15), {head_base('k', 'freq, well, param, date', desc=True, t='time_h')},
v as (select k.*, value / nullif(base, 0) as x from k join hb using (freq, well, param, date)),
m as (select freq, param, date, time_bin, {strict_avg('x')} as value from v group by freq, param, date, time_bin)
{spread('m', 'freq, param, time_bin')}""", BASE + " rel")
def q2(spark, sf):
    return r6(figures.pre_release_summary(
        *_inputs(spark, sf), param="Z", first_bin=-15, max_time=36, exclude=["exp9"]))


# --- around release -----------------------------------------------------------------------------------

_AROUND = f"""with d as (select distinct date from annotations where value = 'SB101-Fc'),
dd as (select date from d where date <> (select min(date) from d)),
w3 as (select date, well, gf, treatment, try_cast(conc_gf as double) as conc, ceil(try_cast(doses_treatment as double)) as dose
  from wide where date in (select date from dd) and gf is not null and conc_gf is not null and treatment is not null
  and celldensity is not null and serum is not null and (ceil(try_cast(doses_treatment as double)) = 0 or ceil(try_cast(doses_treatment as double)) > 1000)),
m3 as (select date, max(time_h) as h from marks where date in (select date from dd) group by date),
src as (select r.*, r.time_h - m3.h as t from readings r left join m3 using (date)
  where date in (select date from dd) and param = 'Z'),
{bins('src', 'date', 't', 'label')},
k as (select b.*, w3.* exclude (date, well) from binned b join w3 on b.date = w3.date and b.well = w3.well
  where time_bin is not null and value is not null),
b0 as (select date, well, avg(value) as base from k where time_bin = 0 group by date, well),
v as (select k.*, value / nullif(base, 0) as x from k left join b0 using (date, well)),
m as (select date, conc, round_even(dose / 1000, 2) as dose, gf, treatment, time_bin, avg(x) as value from v
  group by date, conc, dose, gf, treatment, time_bin),
{labels('m', 2)}, {pairs('lab', 'gf')}, {treated('pr')}"""


@check("q3_around_release_summary", f"""{_AROUND}, a as (select * from tr where time_bin >= 0)
{mean_se('a', 'gf, pair_ind, dose, treat2, time_bin')}""", "readings wide marks")
def q3(spark, sf):
    return r6(figures.around_release_summary(*_inputs(spark, sf), param="Z"))


@check("q4_before_release_summary", f"""{_AROUND}, a as (select gf, pair_ind, date, time_bin, avg(value) as value from tr
  where time_bin <= 0 group by gf, pair_ind, date, time_bin)
{mean_se('a', 'gf, pair_ind, time_bin')}""", "readings wide marks")
def q4(spark, sf):
    return r6(figures.before_release_summary(*_inputs(spark, sf), param="Z"))


_AROUND_4000 = _AROUND.replace("param = 'Z'", "param = 'Z' and freq = 4000")


@check("q3_around_release_at_frequency", f"""{_AROUND_4000}, a as (select * from tr where time_bin >= 0)
{mean_se('a', 'gf, pair_ind, dose, treat2, time_bin')}""", "readings wide marks")
def q3_freq(spark, sf):
    return r6(figures.around_release_summary(*_inputs(spark, sf), param="Z", freq=4000))


@check("q4_before_release_at_frequency", f"""{_AROUND_4000}, a as (select gf, pair_ind, date, time_bin, avg(value) as value from tr
  where time_bin <= 0 group by gf, pair_ind, date, time_bin)
{mean_se('a', 'gf, pair_ind, time_bin')}""", "readings wide marks")
def q4_freq(spark, sf):
    return r6(figures.before_release_summary(*_inputs(spark, sf), param="Z", freq=4000))


# --- gene silencing -----------------------------------------------------------------------------------

_PANELS = "(select 'VEGF' as panel, unnest(['VEGF', 'FBS_5']) as gf union all select 'FGF2', unnest(['bFGF', 'FBS_5'])) pn"
_LEVEL = "case treatment when 'SCR' then 'siNTP' when 'siCD44' then 'siCD44' when 'siVIM' then 'siVIM' when 'UT' then 'UT' end"


def horizon(src: str, name: str = "hz") -> str:
    return f"""{name} as (select * from {src} where time_bin <= (select max(time_bin) from (
  select time_bin from {src} group by time_bin having count(distinct date) >= 2)))"""


@check("q6_sirna_summary", f"""with r0 as (select *, time_h - min(time_h) over (partition by date) as t from rel where {_SILENCING}),
{bins('r0', 'date', 't', 'ordinal')},
k as (select * from binned where time_bin is not null and value is not null), {horizon('k')},
m as (select date, gf, conc, param, freq, treatment, time_bin, avg(value) as value from hz group by all),
p as (select panel, m.* exclude (treatment), {_LEVEL} as treatment from m join {_PANELS} on pn.gf = m.gf where freq >= 1000)
{mean_se('p', 'panel, param, freq, conc, treatment, time_bin')}""", BASE + " rel")
def q6_(spark, sf):
    return r6(figures.sirna_summary(*_inputs(spark, sf)))


_SIRNA = f"""with d as (select distinct date from annotations where value = 'siCD44'),
w7 as (select date, well, gf, {_LEVEL} as treatment, try_cast(conc_gf as double) as conc from wide
  where date in (select date from d) and gf is not null and conc_gf is not null and treatment is not null
  and doses_treatment is not null and celldensity is not null and serum is not null),
m7 as (select date, max(time_h) as h from marks where label like '%GF%' group by date),
src as (select r.*, r.time_h - m7.h as t from {{values}} r left join m7 using (date) where date in (select date from d)),
{bins('src', 'date', 't', 'label')},
k as (select b.*, w7.* exclude (date, well) from binned b join w7 on b.date = w7.date and b.well = w7.well
  where time_bin is not null and value is not null),
series as (select gf, conc from k group by gf, conc having count(distinct date) >= 2)"""


@check("q7_sirna_figure", f"""{_SIRNA.format(values='readings')},
f as (select * from k where time_bin >= -2 and param = 'Z' and freq = 4000), {horizon('f')},
g as (select * exclude (gf), case gf when 'FBS_5' then '5% FBS' when 'FBS_20' then '20% FBS' when 'bFGF' then 'FGF2' else gf end as gf
  from hz where treatment <> 'UT'),
rs as (select gf, conc from g group by gf, conc having count(distinct date) >= 2),
m as (select date, conc, gf, treatment, time_bin, avg(value) as value from g
  where gf = 'GDF-2' or (gf, conc) in (select (gf, conc) from rs) group by date, conc, gf, treatment, time_bin),
p as (select *, case when gf in ('VEGF', 'FGF2') then 'growth factor' when gf = 'GDF-2' then 'GDF-2' else 'FBS' end as panel from m)
{mean_se('p', 'panel, gf, conc, treatment, time_bin')}""", "readings wide marks")
def q7(spark, sf):
    return r6(figures.sirna_figure(*_inputs(spark, sf), freq=4000))


@check("q8_sirna_frequencies", f"""{_SIRNA.format(values='readings')},
m as (select param, freq, date, conc, gf, treatment, time_bin, avg(value) as value from k
  where (gf, conc) in (select (gf, conc) from series) group by param, freq, date, conc, gf, treatment, time_bin),
f as (select * from m where param = 'Z' and freq in (1000, 4000)), {horizon('f')},
p as (select panel, f.* from hz f join {_PANELS} on pn.gf = f.gf)
{mean_se('p', 'panel, freq, conc, treatment, time_bin')}""", "readings wide marks")
def q8(spark, sf):
    return r6(figures.sirna_frequencies(*_inputs(spark, sf)))


@check("q9_barrier_resistance", f"""{_SIRNA.format(values='modelled')},
m as (select param, date, conc, gf, treatment, time_bin, avg(value) as value from k
  where (gf, conc) in (select (gf, conc) from series) group by param, date, conc, gf, treatment, time_bin), {horizon('m')},
p as (select panel, f.* from hz f join {_PANELS} on pn.gf = f.gf where param = 'Rb')
{mean_se('p', 'panel, treatment, conc, time_bin')}""", "readings wide marks modelled")
def q9(spark, sf):
    return r6(figures.barrier_resistance(X.modelled(spark, sf), X.annotations(spark, sf), X.marks(spark, sf)))


@check("q9_barrier_resistance_v1", f"""with st as (select date, min(time_h) as h from rel where {_SILENCING} group by date),
src as (select m.*, m.time_h - st.h as t, a.* exclude (date, well) from modelled m join ann a on m.date = a.date and m.well = a.well
  join st on st.date = m.date), {bins('src', 'date', 't', 'label')},
k as (select panel, b.* exclude (treatment), case when treatment <> 'UT' then {_LEVEL} end as treatment
  from binned b join {_PANELS} on pn.gf = b.gf where time_bin is not null and value is not null and param = 'Rb'),
p as (select panel, time_bin, conc, treatment, value from k where panel = 'VEGF' union all
  select panel, time_bin, conc, treatment, avg(value) from k where panel = 'FGF2' group by panel, date, time_bin, conc, treatment)
{mean_se('p', 'panel, treatment, conc, time_bin')}""", BASE + " rel modelled")
def q9b(spark, sf):
    r, a, m = _inputs(spark, sf)
    return r6(figures.barrier_resistance_v1(X.modelled(spark, sf), r, a, m))


# --- modelled parameters ------------------------------------------------------------------------------

_MODELLED = """r0 as (select m.*, a.* exclude (date, well), m.time_h - min(m.time_h) over (partition by m.date) as t
  from modelled m join ann a on m.date = a.date and m.well = a.well where a.celldensity = '5000'),
s as (select * exclude (dose), ceil(dose) as dose from r0 where dose = 0 or dose > 1000)"""


@check("q10_modelled_summary", f"""with {_MODELLED}, {pairs('s', 'date gf')},
f as (select * from pr where t <= 60 and date <> 'exp9'), {bins('f', 'gf pair_ind', 't', 'ordinal')},
m as (select gf, pair_ind, date, conc, dose, treatment, param, time_bin, {strict_avg('value')} as value from binned
  where time_bin is not null group by gf, pair_ind, date, conc, dose, treatment, param, time_bin), {labels('m', 1)}
{mean_se('lab', 'gf, pair_ind, param, dose, treat2, time_bin')}""", "readings wide ann modelled")
def q10(spark, sf):
    return r6(figures.modelled_summary(X.modelled(spark, sf), X.annotations(spark, sf), max_time=60, exclude=["exp9"]))


@check("q10_modelled_summary_of_class", f"""with {_MODELLED.replace("= '5000')", "= '5000' and a.date in " + _SERUM + ")")}, {pairs('s', 'date gf')},
f as (select * from pr where t <= 60 and date <> 'exp9'), {bins('f', 'gf pair_ind', 't', 'ordinal')},
m as (select gf, pair_ind, date, conc, dose, treatment, param, time_bin, {strict_avg('value')} as value from binned
  where time_bin is not null group by gf, pair_ind, date, conc, dose, treatment, param, time_bin), {labels('m', 1)}
{mean_se('lab', 'gf, pair_ind, param, dose, treat2, time_bin')}""", "readings wide ann modelled")
def q10_class(spark, sf):
    return r6(figures.modelled_summary(X.modelled(spark, sf), X.annotations(spark, sf), max_time=60, exclude=["exp9"],
                                       experiments=_with_serum(spark, sf)))


def _qc(column: str):
    @check(f"q10_histogram_{column}", f"""with {_MODELLED}, {pairs('s', 'date gf')},
e as (select gf, pair_ind, min({column}) as lo, max({column}) as hi from pr group by gf, pair_ind)
select gf, pair_ind, treatment, cast(case when hi = lo then 1 else least(floor(({column} - lo) * 30 / (hi - lo)), 29) + 1 end as integer) as bin, count(*) as n
from pr join e using (gf, pair_ind) group by gf, pair_ind, treatment, bin""", "readings wide ann modelled")
    def run(spark, sf):
        return figures.modelled_qc(X.modelled(spark, sf), X.annotations(spark, sf), column)
    return run


_qc("rmse")
_qc("drift")


# --- overviews ----------------------------------------------------------------------------------------

def _overview(kind: str):
    value = {"Raw": "value", "Divide": "value / nullif(base, 0)", "Subtract": "value - base"}[kind]
    lab = r"regexp_replace(cast(conc as varchar), '\.0$', '')"

    @check(f"q11_treatments_{kind.lower()}", f"""with r0 as (select *, time_h - min(time_h) over (partition by date) as t from rel),
s as (select * from r0 where t <= 30 and (dose = 0 or dose > 100)), {head_base('s', 'date, well, param, freq', 1)},
v as (select date, gf, param, conc, treatment, dose, freq, t as time_h, {value} as x from s join hb using (date, well, param, freq)),
m as (select date, gf, param, conc, treatment, dose, freq, time_h, avg(x) as y, stddev_samp(x) / sqrt(count(x)) as se from v
  group by date, gf, param, conc, treatment, dose, freq, time_h), {pairs('m', 'date gf param')},
g as (select date, gf, param, pair_ind, conc, row_number() over w as i, count(*) over (partition by date, gf, param, pair_ind) as n
  from (select distinct date, gf, param, pair_ind, conc from pr) window w as (partition by date, gf, param, pair_ind order by conc)),
gl as (select date, gf, param, pair_ind, gf || '-' || {lab} as group_label from g where i = least(2, n))
select date, gf, param, pair_ind, conc, treatment, dose, freq, {q6('time_h')} as time_h, group_label,
  {lab} || '-' || gf || '-' || treatment as legend,
  case when dose = 0 then '[0,1]' when dose <= 402 then '(128,402]' when dose <= 1267 then '(402,1.27e+03]' else '(1.27e+03,4e+03]' end as dose_bin,
  {q6('y')} as y, {q6('y - se')} as y_min, {q6('y + se')} as y_max
from pr join gl using (date, gf, param, pair_ind)""", BASE + " rel")
    def run(spark, sf):
        return r6(figures.treatment_overview(*_inputs(spark, sf), kind, max_time=30))
    return run


for _kind in ("Raw", "Divide", "Subtract"):
    _overview(_kind)


@check("q12_setup_readings", f"""with r0 as (select p.*, a.* exclude (date, well), round(p.time_h - min(p.time_h) over (partition by p.date) + 1e-8, 6) + 0.0 as t
  from phased p join ann a on p.date = a.date and p.well = a.well where p.mark = 'Release' and a.serum = 'FBS')
{mean_se('r0', 'date, gf, param, freq, conc, celldensity, t').replace(', t,', ', t as time_h,', 1)}""", BASE)
def q12(spark, sf):
    return r6(figures.setup_overview(*_inputs(spark, sf)))


@check("q12_setup_readings_of_class", f"""with r0 as (select p.*, a.* exclude (date, well), round(p.time_h - min(p.time_h) over (partition by p.date) + 1e-8, 6) + 0.0 as t
  from phased p join ann a on p.date = a.date and p.well = a.well where p.mark = 'Release' and a.serum = 'FBS' and a.date not in {_SERUM})
{mean_se('r0', 'date, gf, param, freq, conc, celldensity, t').replace(', t,', ', t as time_h,', 1)}""", BASE)
def q12_class(spark, sf):
    rest = dates_of_class(X.annotations(spark, sf), lacking=("serum",))
    return r6(figures.setup_overview(*_inputs(spark, sf), experiments=rest))


@check("q12_setup_modelled", f"""with r0 as (select m.*, a.* exclude (date, well), round(m.time_h - min(m.time_h) over (partition by m.date) + 1e-8, 6) + 0.0 as t
  from modelled m join ann a on m.date = a.date and m.well = a.well where a.serum = 'FBS')
{mean_se('r0', 'date, gf, param, conc, celldensity, t').replace(', t,', ', t as time_h,', 1)}""", "readings wide ann modelled")
def q12b(spark, sf):
    return r6(figures.setup_overview_modelled(X.modelled(spark, sf), X.annotations(spark, sf)))


# --- hourly means and dose response -------------------------------------------------------------------

_HOURLY = f"""{bins('readings', '', 'time_h', 'ordinal')},
h as (select date, well, param, freq, time_bin, {strict_avg('value')} as value from binned where time_bin is not null
  group by date, well, param, freq, time_bin)"""


@check("q15_hourly_well_means_of_class", f"""with v as (select * from modelled where date in {_SERUM}), {bins('v', '', 'time_h', 'ordinal')},
h as (select date, well, param, time_bin, {q6(strict_avg('value'))} as value from binned where time_bin is not null
  group by date, well, param, time_bin)
select h.*, w.* exclude (date, well) from h join wide w on h.date = w.date and h.well = w.well""", "readings wide modelled")
def q15_class(spark, sf):
    return r6(figures.hourly_well_means(X.modelled(spark, sf), X.annotations(spark, sf), others=None,
                                        experiments=_with_serum(spark, sf)))


@check("q15_hourly_well_means", f"""with {bins('modelled', '', 'time_h', 'ordinal')},
h as (select date, well, param, time_bin, {q6(strict_avg('value'))} as value from binned where time_bin is not null
  group by date, well, param, time_bin)
select h.*, w.* exclude (date, well) from h join wide w on h.date = w.date and h.well = w.well""", "readings wide modelled")
def q15(spark, sf):
    return r6(figures.hourly_well_means(X.modelled(spark, sf), X.annotations(spark, sf), others=None))


def _dose(name: str, gfs: tuple, pool: str, pools: dict, extra: tuple, serum: str | None, rename: dict | None = None):
    keys = ", ".join(("time_bin", "parameter", "gf", "conc", *extra))
    lvl = "('Z1k', 'Z2k', 'Z4k', 'Z8k', 'Z16k', 'Z32k', 'Z64k')"
    members = ", ".join(f"'{g}'" for g in gfs)
    gf = "a.gf" if not rename else "case a.gf " + " ".join(f"when '{x}' then '{y}'" for x, y in rename.items()) + " else a.gf end"

    @check(name, f"""with {_HOURLY}, e as (
  select h.*, {gf} as gf, a.celldensity, floor(round(pow(10, log10(greatest(a.conc, 1))), 9)) as c from h
  join ann a on h.date = a.date and h.well = a.well where {gf} in ({members}) {"and a.date in (select date from annotations where layer = 'serum')" if serum else ''}),
q as (select *, cast({pool} as bigint) as conc, param || cast(freq // 1000 as varchar) || 'k' as parameter from e),
m as (select date, {keys}, avg(value) as value from q group by date, {keys}),
cut as (select min(n) as n from (select date, count(distinct time_bin) as n from m group by date)),
z as ({spread('m', keys).replace(' from m ', ' from m where time_bin <= (select n from cut) ')})
select * exclude (parameter), case when parameter in {lvl} then parameter end as parameter,
  cast(case parameter when 'Z1k' then 1 when 'Z2k' then 2 when 'Z4k' then 3 end as integer) as parameter_ord
from z where mean is not null and sd is not null""", "readings wide ann")
    def run(spark, sf):
        hourly = figures.hourly_well_means(X.readings(spark, sf), None, ("date", "well", "param", "freq"))
        wide = figures.wide_annotations(X.annotations(spark, sf)).withColumn(
            "log_conc", F.log10(F.greatest(F.col("conc"), F.lit(1.0)))).drop("conc")
        wide = wide.replace(rename, subset=["gf"]) if rename else wide
        return r6(figures.dose_response(hourly.join(wide, ["date", "well"]), gfs, pools, extra, serum))
    return run


_dose("q13_dose_response_vegf", ("VEGF",),
      "case when c in (1, 2) then 2 when c in (6, 7) then 7 when c in (19, 25) then 25 else c end", numbers.POOL_VEGF, (), "FBS")
_dose("q13_dose_response_hgf_bfgf", ("HGF", "bFGF"),
      "case when c in (1, 2, 3) then 3 when c in (5, 6, 7) then 7 when c in (12, 15) then 15 when c in (19, 25, 39) then 25 else c end",
      numbers.POOL_HGF_FGF, ("celldensity",), None)


# No well of these tables has GDF-2, so those of another growth factor stand for it.
_dose("q13_dose_response_gdf2", ("GDF-2",),
      "case when c in (1, 2) then 2 when c in (6, 7) then 7 when c in (19, 25) then 25 when c in (63, 79) then 79 "
      "when c in (251, 316) then 316 else c end", numbers.POOL_GDF2, ("celldensity",), None, {"bFGF": "GDF-2"})


_SPECTRUM = "(select 'VEGF' as panel, unnest(['VEGF', 'FBS_5']) as gf union all select 'bFGF', unnest(['bFGF', 'FBS_5']) " \
            "union all select 'GDF-2', unnest(['GDF-2', 'FBS_5']) union all select 'FBS', unnest(['FBS_20', 'FBS_5'])) pn"


def _spectrum(name: str, how: str, expr: str):
    @check(name, f"""with r0 as (select *, time_h - min(time_h) over (partition by date) as t from rel where {_SILENCING}),
{bins('r0', 'date', 't', 'ordinal')}, {head_base('binned', 'date, well, param, freq', 1)},
p as (select panel, b.*, {expr} as x from binned b join hb using (date, well, param, freq) join {_SPECTRUM} on pn.gf = b.gf
  where time_bin is not null)
{mean_se('p', 'panel, param, freq, treatment, conc, time_bin', 'x')}""", BASE + " rel")
    def run(spark, sf):
        return r6(figures.frequency_spectrum(*_inputs(spark, sf), how))
    return run


_spectrum("q14_frequency_spectrum", "div_first", "value / nullif(base, 0)")
_spectrum("q14_frequency_spectrum_change", "sub_first", "value - base")


def _early(name: str, subtract: bool, expr: str):
    @check(name, f"""with r0 as (select *, time_h - min(time_h) over (partition by date) as t from rel where {_SILENCING}),
{bins('r0', 'date', 't', 'ordinal')}, k as (select * from binned where time_bin is not null and value is not null),
{horizon('k')}, {head_base('hz', 'date, well, param, freq')},
p as (select panel, b.*, {expr} as x from hz b join hb using (date, well, param, freq) join
  (select * from {_SPECTRUM} where panel <> 'GDF-2') pn on pn.gf = b.gf)
{mean_se('p', 'panel, param, freq, conc, treatment, time_bin', 'x')}""", BASE + " rel")
    def run(spark, sf):
        return r6(figures.early_sirna(*_inputs(spark, sf), subtract))
    return run


_early("q16_early_sirna_raw", False, "value")
_early("q16_early_sirna_change", True, "value - base")
