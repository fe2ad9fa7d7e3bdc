"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.registry import check, q6, r6
from platewise.functions import text
from platewise.session import new_path
from platewise.sources import files, tables

_PATHS_SQL = """paths as (
  select p_partkey, 'rawdata/RUN_' || lpad(cast(p_partkey as varchar), cast(4 + p_partkey % 3 as integer), '0') ||
         case p_size % 6 when 0 then '_MFT_1.xls' when 1 then '_MFT_3.xls' when 2 then '_MFT_1_RbA.csv'
                         when 3 then '_Metadata_treatment.csv' when 4 then '_metadata_conc_GF.csv' else '_notes.txt' end as path
  from part)"""


def _paths(spark, sf):
    p = X.table(spark, sf, "part")
    n = F.col("p_size") % 6
    suffix = (F.when(n == 0, "_MFT_1.xls").when(n == 1, "_MFT_3.xls").when(n == 2, "_MFT_1_RbA.csv")
              .when(n == 3, "_Metadata_treatment.csv").when(n == 4, "_metadata_conc_GF.csv").otherwise("_notes.txt"))
    digits = F.lpad(F.col("p_partkey").cast("string"), (F.lit(4) + F.col("p_partkey") % 3).cast("int"), F.lit("0"))
    return p.select("p_partkey", F.concat(F.lit("rawdata/RUN_"), digits, suffix).alias("path"))


@check("s1_input_kinds", f"""with {_PATHS_SQL}
select path,
       case when regexp_matches(path, '_RbA.csv') then 'modelled'
            when regexp_matches(path, '_[Mm]etadata_([A-Za-z]+)_*([A-Za-z]*).csv') then 'layer'
            when regexp_matches(path, '_[1,2]{{1}}.xls') then 'measurement' end as kind_v1,
       case when regexp_matches(path, '_RbA.csv') then 'modelled'
            when regexp_matches(path, '_Metadata') then 'layer'
            when regexp_matches(path, '_[1,2]{{1}}.xls') then 'measurement' end as kind_v2
from paths""")
def s1(spark, sf):
    return _paths(spark, sf).select(
        "path", text.input_kind("path", 1).alias("kind_v1"), text.input_kind("path", 2).alias("kind_v2"))


@check("s2_date_from_path", f"""with {_PATHS_SQL}
select path,
       case when regexp_matches(path, '[0-9]{{6}}') then '20' || regexp_extract(path, '[0-9]{{6}}') end as date_v1,
       regexp_replace(path, '^.+([0-9]{{6}}).+$', '\\1') as date_v2
from paths""")
def s2(spark, sf):
    return _paths(spark, sf).select(
        "path", text.date_from_path("path", 1).alias("date_v1"), text.date_from_path("path", 2).alias("date_v2"))


_SHEETS_SQL = """cells as (
  select e.f, e.l, e.a, v.value
  from (select f, l, a from (select distinct event_id // 768 as f, (event_id % 768) // 96 as l from events),
               (select unnest(range(96)) as a)) e
  left join events v on v.event_id = e.f * 768 + e.l * 96 + e.a), sheets as (
  select lpad(cast(f as varchar), 6, '0') as date, well,
         case f % 3 when 0 then 'Z' when 1 then 'R' else 'C' end as param,
         cast(case f % 4 when 0 then 1000 when 1 then 2000 when 2 then 4000 else 8000 end as integer) as freq,
         l / 4.0::double as time_h, value
  from cells join wells on wells.i = cells.a)"""


@check("s3_sheets_to_long", f"""with {_SHEETS_SQL}
select 'rawdata/RUN_' || date || '_MFT_1.xls/' || param || ' ' || freq || ' Hz.csv' as path,
       param || ' ' || freq || ' Hz' as sheet, time_h, well || ' ' || param as variable, value from sheets""", "wells")
def s3(spark, sf):
    # Sheets of comments and details lie among the readings' sheets and are left out.
    texts = X.sheet_texts(spark, sf).unionByName(X.comment_texts(spark, sf)).unionByName(X.detail_texts(spark, sf))
    return files.sheets_to_long(texts)


@check("s3_readings_from_sheets", f"with {_SHEETS_SQL} select * from sheets", "wells")
def s3b(spark, sf):
    return files.readings_from_sheets(X.sheet_texts(spark, sf))


@check("s4_unpivot_readings", """with p as (
  select date, well, time_h, x.p as variable, case when param = x.p then value end as value
  from readings, (select unnest(['Z', 'R', 'C', 'Rb', 'Alpha']) as p) x)
select * from p""", "readings")
def s4(spark, sf):
    wide = X.readings(spark, sf).select("date", "well", "time_h", *[
        F.when(F.col("param") == p, F.col("value")).alias(p) for p in ("Z", "R", "C", "Rb", "Alpha")])
    return files.unpivot_readings(wide, ["date", "well", "time_h"])


@check("s5_split_variable", r"""with v as (select well, param, well || ' ' || param as v2, well || '.' || param as v1 from readings)
-- names of a measured parameter and a well of one letter and at most two digits are taken apart, others are kept
select v1, v2, case when sound then well else v2 end as well_v2, case when sound then param else v2 end as param_v2,
       case when sound then well else v1 end as well_v1, case when sound then param end as param_v1
from (select *, param in ('Z', 'R', 'C') and ascii(well) between 65 and 72 and length(well) between 2 and 3 as sound from v)""", "readings")
def s5(spark, sf):
    v = X.readings(spark, sf).select(F.concat_ws(".", "well", "param").alias("v1"),
                                     F.concat_ws(" ", "well", "param").alias("v2"))
    return v.select(
        "v1", "v2", text.well_from_variable("v2").alias("well_v2"), text.param_from_variable("v2").alias("param_v2"),
        text.well_from_variable("v1", 1).alias("well_v1"), text.param_from_variable("v1", 1).alias("param_v1"))


@check("s6_freq_from_sheet", r"""with s as (
  select param || case when freq = 2000 then ' scan ' else ' ' end || freq || case when param = 'C' then '' else ' Hz' end as sheet
  from readings)
select sheet, try_cast(regexp_extract(sheet, '[0-9]+') as integer) as freq_v1,
       try_cast(nullif(regexp_extract(sheet, '^.+ ([0-9]+) .+$', 1), '') as integer) as freq_v2 from s""", "readings")
def s6(spark, sf):
    r = X.readings(spark, sf)
    sheet = F.concat("param", F.when(F.col("freq") == 2000, " scan ").otherwise(" "), F.col("freq").cast("string"),
                     F.when(F.col("param") == "C", "").otherwise(" Hz"))
    return r.select(sheet.alias("sheet")).select(
        "sheet", text.freq_from_sheet("sheet", 1).alias("freq_v1"), text.freq_from_sheet("sheet", 2).alias("freq_v2"))


@check("s7_parse_marks", """select cast(o_custkey as varchar) as date, o_totalprice as time_h,
  'GF ' || o_orderpriority as label from orders""")
def s7(spark, sf):
    return files.parse_marks(X.comment_rows(spark, sf))


@check("s7_marks_from_sheets", """select '99000' || substr(date, 4, 1) as date, time_h, label from marks""", "marks")
def s7b(spark, sf):
    return files.parse_marks(files.comment_lines(X.comment_texts(spark, sf)))


@check("s8_details_wide", """select cast(c_custkey as varchar) as date, c_name as name,
  cast(c_nationkey as varchar) as nation, c_mktsegment as segment, 'op' || c_nationkey as operator from customer""")
def s8(spark, sf):
    return files.details_wide(X.detail_rows(spark, sf), {
        "Name": "name", "Nation": "nation", "Segment": "segment", "Operator": "operator"})


@check("s8_details_from_sheets", """select lpad(cast(c_custkey as varchar), 6, '0') as date, u.key, u.value from customer,
  unnest([{'key': 'key1', 'value': c_name}, {'key': 'key2', 'value': cast(c_nationkey as varchar)},
          {'key': 'key3', 'value': c_mktsegment}, {'key': 'key4', 'value': cast(c_custkey as varchar)},
          {'key': 'key5', 'value': 'a'}, {'key': 'key6', 'value': 'b'}, {'key': 'key7', 'value': 'c'},
          {'key': 'key8', 'value': '2013-12-' || lpad(cast(c_nationkey + 1 as varchar), 2, '0')}]) as t(u)""")
def s8b(spark, sf):
    return files.detail_pairs(X.detail_texts(spark, sf)).select("date", "key", "value")


@check("s8_date_from_details", """select lpad(cast(c_custkey as varchar), 6, '0') as date,
  '201312' || lpad(cast(c_nationkey + 1 as varchar), 2, '0') as recorded from customer""")
def s8c(spark, sf):
    return files.date_from_details(files.detail_pairs(X.detail_texts(spark, sf), 2))


@check("s9_plate_to_long", """with plates as (select distinct p_partkey // 96 as f from part)
select lpad(cast(f as varchar), 6, '0') as date, chr(65 + r) || cast(c + 1 as varchar) as well, 'p_size' as layer,
       cast(p.p_size as varchar) as value
from plates, (select cast(unnest(range(8)) as integer) as r) a, (select cast(unnest(range(12)) as integer) as c) b
left join part p on p.p_partkey = f * 96 + r * 12 + c""")
def s9(spark, sf):
    return files.plate_to_long(X.plate_texts(spark, sf))


@check("s10_annotations_wide", """select date, well, gf as "GF", conc_gf as "concGF", treatment,
  doses_treatment as dosestreatment, celldensity, serum from wide""", "wide")
def s10(spark, sf):
    return files.annotations_wide(X.annotations(spark, sf), [
        "GF", "conc_GF", "treatment", "doses_treatment", "celldensity", "serum"])


@check("s11_union_layers", """select date, well, gf as "GF", case when serum is not null then conc_gf end as "concGF",
  coalesce(serum, 'FBS') as serum from wide""", "wide")
def s11(spark, sf):
    wide = files.annotations_wide(X.annotations(spark, sf), ["GF", "conc_GF", "serum"])
    with_serum = wide.where(F.col("serum").isNotNull())
    without = wide.where(F.col("serum").isNull()).drop("serum", "concGF")
    return files.union_layers([with_serum, without])


_MODELLED_SQL = """lines as (select distinct event_id // 1920 as f, (event_id % 1920) // 480 as l from events), cells as (
  select f, l, w.i, w.well, k, v.value from lines, wells w, (select unnest(range(5)) as k) ks
  left join events v on v.event_id = f * 1920 + l * 480 + w.i * 5 + k)"""


@check("s12_read_modelled_v1", f"""with {_MODELLED_SQL}, wide_m as (
  select f, l, well, max(value) filter (k = 0) as rb, max(value) filter (k = 1) as alpha, max(value) filter (k = 2) as cap,
         max(value) filter (k = 3) as drift, max(value) filter (k = 4) as rmse from cells group by f, l, well)
select '20' || lpad(cast(f as varchar), 6, '0') as date, well, l / 4.0::double as time_h, drift, rmse, p as param,
       case p when 'Rb' then rb when 'Alpha' then alpha else cap end as value
from wide_m, (select unnest(['Rb', 'Alpha', 'CellMCap']) as p) ps""", "wells")
def s12(spark, sf):
    return files.read_modelled_v1(X.modelled_texts(spark, sf))


@check("s13_read_modelled_v2", f"""with {_MODELLED_SQL}
select lpad(cast(f as varchar), 6, '0') as date, well,
       case k when 0 then 'Rb' when 1 then 'Alpha' when 2 then 'CellMCap' when 3 then 'Drift' else 'RMSE' end as param,
       l / 4.0::double as time_h, value from cells""", "wells")
def s13(spark, sf):
    return files.read_modelled_v2(X.modelled_texts(spark, sf))


@check("s14_write_and_reload", "select * from readings", "readings")
def s14(spark, sf):
    r, path = X.readings(spark, sf), new_path(spark, "readings")
    tables.write_table(r, path, "append")
    tables.write_table(r.where(F.col("date") == "exp3"), path, "reload")
    return tables.read_table(spark, path, r.schema).select(*r.columns)


_BOOK = "date || '-' || case when substr(well, 1, 1) < 'E' then 'upper' else 'lower' end"


@check("s14_reload_of_workbooks", f"""select r.* exclude (value), {_BOOK} as workbook,
  case when date in ('exp3', 'exp4') and substr(well, 1, 1) < 'E' then value + 1 else value end as value from readings r
  where not (date = 'exp4' and substr(well, 1, 1) < 'E' and param = 'Z')""", "readings")
def s14b(spark, sf):
    # two workbooks a date; one of each of two dates is loaded again, with other values and, once, fewer rows
    path = new_path(spark, "workbooks")
    r = X.readings(spark, sf).withColumn("workbook", F.expr(_BOOK))
    again = r.where("date in ('exp3', 'exp4') and workbook like '%upper' and not (date = 'exp4' and param = 'Z')")
    tables.reload_keyed(r, path)
    tables.reload_keyed(again.withColumn("value", F.col("value") + 1), path)
    return tables.read_keyed(spark, path, r.schema)


@check("s15_table_scan", "select * from part")
def s15(spark, sf):
    return tables.read_table(spark, f"{sf}/part.parquet")


_FIELDS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderdate", "timestamp_ntz"), ("o_totalprice", "double"))


@check("s16_list_fields", " union all ".join(
    f"select {i} as position, '{name}' as name, '{kind}' as type, count({name}) as present, count(*) - count({name}) as missing from orders"
    for i, (name, kind) in enumerate(_FIELDS, 1)))
def s16(spark, sf):
    return tables.field_report(tables.read_table(spark, f"{sf}/orders.parquet").select(*[n for n, _ in _FIELDS]))


@check("s17_csv_export", f"""select cast(row_number() over (order by date, param) as bigint) as row, date, param,
  {q6('avg(value)')} as mean, count(*) as n from readings group by date, param""", "readings")
def s17(spark, sf):
    path = new_path(spark, "export")
    figure = X.readings(spark, sf).groupBy("date", "param").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    tables.export_csv(figure, path, ["date", "param"])
    return r6(spark.read.option("header", "true").csv(
        path, schema="row bigint, date string, param string, mean double, n bigint"))


@check("s18_snapshot", f"""select well, {q6('avg(value)')} as mean from readings group by well""", "readings")
def s18(spark, sf):
    figure = X.readings(spark, sf).groupBy("well").agg(F.avg("value").alias("mean"))
    return r6(tables.snapshot(figure, new_path(spark, "snapshot")))


@check("s19_preview", "select * from readings order by time_h limit 6", "readings")
def s19(spark, sf):
    return tables.preview(X.readings(spark, sf), 6, ["time_h"])


@check("q17_ingest_all", f"""with {_SHEETS_SQL}, {_MODELLED_SQL.replace('cells as', 'mcells as')}, loaded as (
  select 'readings' as name, date, value from sheets
  union all select 'marks', '99000' || substr(date, 4, 1), time_h from marks
  union all select 'details', lpad(cast(c_custkey as varchar), 6, '0'), 8.0 from customer
  union all select 'annotations', lpad(cast(p_partkey // 96 as varchar), 6, '0'), p_size from part
  union all select 'modelled', lpad(cast(f as varchar), 6, '0'), value from mcells)
select name, date, cast(count(value) * case name when 'details' then 8 else 1 end as bigint) as n,
       {q6("case when name <> 'details' then sum(value) end")} as total
from loaded group by name, date""", "wells marks")
def q17(spark, sf):
    texts = X.sheet_texts(spark, sf)
    for more in (X.comment_texts, X.detail_texts, X.plate_texts, X.modelled_texts):
        texts = texts.unionByName(more(spark, sf))
    out = files.ingest(texts)
    parts = [
        out["readings"].select(F.lit("readings").alias("name"), "date", F.col("value").alias("v"), F.col("value")),
        out["marks"].select(F.lit("marks").alias("name"), "date", F.col("time_h").alias("v"), F.col("time_h").alias("value")),
        out["details"].select(F.lit("details").alias("name"), "date", F.lit(1.0).alias("v"),
                              F.lit(None).cast("double").alias("value")),
        out["annotations"].select(F.lit("annotations").alias("name"), "date", text.to_number("value").alias("v"),
                                  text.to_number("value").alias("value")),
        out["modelled"].select(F.lit("modelled").alias("name"), "date", F.col("value").alias("v"), F.col("value"))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return r6(both.groupBy("name", "date").agg(F.count("v").alias("n"), F.sum("value").alias("total")))


@check("s8_details_by_workbook", """select lpad(cast(c_custkey // 2 as varchar), 6, '0') as date,
  'RUN_' || lpad(cast(c_custkey // 2 as varchar), 6, '0') || '_MFT_' || cast(c_custkey % 2 + 1 as varchar) || '.xls' as workbook,
  c_name as name, cast(c_nationkey as varchar) as nation, c_mktsegment as segment from customer""")
def s8d(spark, sf):
    pairs = files.detail_pairs(X.twin_detail_texts(spark, sf), identity=True)
    return files.details_wide(pairs, {"key1": "name", "key2": "nation", "key3": "segment"})
