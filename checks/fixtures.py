"""Plate-assay tables derived from the given parquet tables, in Spark and as SQL text.

See FIXTURES.md for the derivation. The SQL texts are written from the same definitions for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.reshape import well_name


# Columns of the given tables that are used here, so that no job is spent on reading schemas.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly by key. A table's file may be one task's, and every row here becomes a file's worth of text or rows:
    such work is spread over the cluster, as files are, while the rows are still narrow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _micros(ts) -> F.Column:
    """Microseconds since 2024-01-01 from the fields of a zone-free time stamp, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("2024-01-01")).cast("long")
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60000000 + micros


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    unit = F.floor(F.col("user_id") / 10)
    return ev.select(
        F.concat(F.lit("exp"), (F.col("user_id") % 10).cast("string")).alias("date"),
        well_name(unit % 8, F.floor(unit / 8)).alias("well"),
        F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", "R")
        .when(F.col("event_type") == "signup", "C").when(F.col("event_type") == "purchase", "Rb")
        .otherwise("Alpha").alias("param"),
        (F.pow(F.lit(2), F.col("event_id") % 3).cast("int") * 1000).alias("freq"),
        (_micros(F.col("ts")) / F.lit(36000000000.0)).alias("time_h"),
        "value")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    w = F.floor(F.col("user_id") / 10)
    d = (F.col("user_id") % 10).cast("int")
    return u.select(
        F.concat(F.lit("exp"), d.cast("string")).alias("date"), well_name(w % 8, F.floor(w / 8)).alias("well"),
        d.alias("d"), w.alias("w"),
        F.when(d % 3 == 0, "VEGF").when(d % 3 == 1, "bFGF").otherwise("FBS_5").alias("gf"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    w = F.col("w")
    conc = F.when(F.col("gf") == "FBS_5", "0").otherwise(
        F.when(w % 3 == 0, "0").when(w % 3 == 1, "8").otherwise("25"))
    treatment = F.when(w % 4 == 0, "hIgG-Fc").when(w % 4 == 1, "SB101-Fc").when(w % 4 == 2, "SCR").otherwise("siCD44")
    dose = F.when(w % 5 == 0, "0").when(w % 5 == 1, "400").when(w % 5 == 2, "1265").when(w % 5 == 3, "4000").otherwise(
        "999.5")
    density = F.when(w % 15 == 14, "10000").otherwise("5000")
    serum = F.when(F.col("d") % 2 == 0, "FBS")
    pairs = [("GF", F.col("gf")), ("conc_GF", conc), ("treatment", treatment), ("doses_treatment", dose),
             ("celldensity", density), ("serum", serum)]
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), v.alias("value")) for n, v in pairs])
    return u.select("date", "well", F.explode(layers).alias("a")).select("date", "well", "a.layer", "a.value").where(
        F.col("value").isNotNull())


def more_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with layers that are not among the named ones: a passage in odd experiments, a medium in even wells."""
    u = units(spark, sf_dir)
    w = F.col("w")
    pairs = [("passage", F.when(F.col("d") % 2 == 1, F.concat(F.lit("P"), (w % 4 + 3).cast("string")))),
             ("medium", F.when(w % 2 == 0, "M199"))]
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), v.alias("value")) for n, v in pairs])
    more = u.select("date", "well", F.explode(layers).alias("a")).select("date", "well", "a.layer", "a.value")
    return annotations(spark, sf_dir).unionByName(more.where(F.col("value").isNotNull()))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("d")).distinct()
    spans = F.array(
        F.struct(((80 + F.col("d")) / F.lit(10.0)).alias("time_h"), F.lit("Starv").alias("label")),
        F.struct(F.when(F.col("d") % 5 != 4, (200 + F.col("d")) / F.lit(10.0)).alias("time_h"),
                 F.lit("Preinc").alias("label")),
        F.struct(((240 + F.col("d")) / F.lit(10.0)).alias("time_h"), F.lit("GF added").alias("label")))
    return d.select(F.concat(F.lit("exp"), F.col("d").cast("string")).alias("date"), F.explode(spans).alias("m")).select(
        "date", "m.time_h", "m.label").where(F.col("time_h").isNotNull())


def spoiled_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of which some dates have one, four, none, two at one time, one without a time, one before the start."""
    m = marks(spark, sf_dir)
    is_ = lambda date, label: (F.col("date") == date) & (F.col("label") == label)
    time = F.when(is_("exp7", "Starv"), -0.5).when(~is_("exp6", "Preinc"), F.col("time_h"))
    kept = m.where(((F.col("date") != "exp1") | (F.col("label") == "Starv")) & (F.col("date") != "exp5"))
    kept = kept.select("date", time.alias("time_h"), "label")
    extra = m.where(is_("exp2", "Starv")).select("date", F.lit(30.0).alias("time_h"), F.lit("extra").alias("label"))
    again = m.where(is_("exp4", "Starv")).select("date", "time_h", F.lit("again").alias("label"))
    return kept.unionByName(extra).unionByName(again)


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled values: Rb and Alpha, with drift and fit error beside them."""
    rows = readings(spark, sf_dir).where(F.col("param").isin("Rb", "Alpha"))
    return rows.select("date", "well", "param", "time_h", "value", (F.col("value") % 1).alias("drift"),
                       (F.col("value") / 100).alias("rmse"))


# --- texts ------------------------------------------------------------------------------------------
# A file holds a fixed number of consecutive rows of a table, so that no text grows with the table.

def _digits(n) -> F.Column:
    return F.lpad(n.cast("string"), 6, "0")


def _grid_text(df: DataFrame, key, value, per_line: int, lines: int) -> DataFrame:
    """(file, line, text): comma-joined values of `per_line` consecutive keys; short lines are padded."""
    size = per_line * lines
    placed = df.select(
        F.floor(key / size).alias("file"), (F.floor(key / per_line) % lines).alias("line"),
        (key % per_line).alias("at"), value.cast("string").alias("v"))
    joined = placed.groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))
    blanks = F.array_repeat(F.lit(""), F.lit(per_line) - F.size("c"))
    return joined.select("file", "line", F.array_join(
        F.concat(F.transform("c", lambda x: x["v"]), blanks), ",").alias("text"))


def _file_text(lines: DataFrame, head: list, path) -> DataFrame:
    """(path, content) from numbered lines, after fixed head lines."""
    body = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    content = F.array_join(F.concat(F.array(*head), F.transform("l", lambda x: x["text"])) if head
                           else F.transform("l", lambda x: x["text"]), "\n")
    return body.select(path.alias("path"), content.alias("content"))


WELLS = [f"{r}{c}" for c in range(1, 13) for r in "ABCDEFGH"]


def plate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """96 parts make a plate of sizes; part key order runs along the plate's rows."""
    lines = _grid_text(table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size"), 12, 8)
    return _file_text(lines, [], F.concat(F.lit("rawdata/RUN_"), _digits(F.col("file")), F.lit("_Metadata_p_size.csv")))


def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """768 events make a sheet of 8 times and 96 wells; parameter and frequency follow the sheet's number."""
    ev = table(spark, sf_dir, "events")
    lines = _grid_text(ev, F.col("event_id"), F.col("value"), 96, 8).withColumn(
        "text", F.concat((F.col("line") / F.lit(4.0)).cast("string"), F.lit(","), F.col("text")))
    param = F.element_at(F.array(F.lit("Z"), F.lit("R"), F.lit("C")), (F.col("file") % 3 + 1).cast("int"))
    head = F.concat(F.lit("Time (hrs),"), F.array_join(
        F.transform(F.array(*[F.lit(w) for w in WELLS]), lambda w: F.concat(w, F.lit(" "), param)), ","))
    freq = (F.pow(F.lit(2), F.col("file") % 4).cast("int") * 1000).cast("string")
    path = F.concat(F.lit("rawdata/RUN_"), _digits(F.col("file")), F.lit("_MFT_1.xls/"), param, F.lit(" "), freq,
                    F.lit(" Hz.csv"))
    return _file_text(lines, [head], path)


def modelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1920 events make a modelled export of 4 times and 96 wells by 5 parameters, with two header lines."""
    from platewise.schema import MODEL_PARAMS
    ev = table(spark, sf_dir, "events")
    lines = _grid_text(ev, F.col("event_id"), F.col("value"), 480, 4).withColumn(
        "text", F.concat((F.col("line") / F.lit(4.0)).cast("string"), F.lit(","), F.col("text")))
    head = [F.lit(f"preamble {i}") for i in range(19)]
    head.append(F.lit("Time (hrs), " + ", ".join(p for _ in WELLS for p in MODEL_PARAMS)))
    head.append(F.lit("well, " + ", ".join(w for w in WELLS for _ in MODEL_PARAMS)))
    head += [F.lit("unit"), F.lit("")]
    return _file_text(lines, head, F.concat(F.lit("rawdata/RUN_"), _digits(F.col("file")), F.lit("_MFT_1_RbA.csv")))


def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three comment lines per order: a mark with a time, a blank line, a label; dates are customers."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderkey") * 4
    rows = F.array(
        F.struct(at.alias("line_no"), F.concat(F.lit("<Mark> Time: "), F.col("o_totalprice").cast("string")).alias("text")),
        F.struct((at + 1).alias("line_no"), F.lit("").alias("text")),
        F.struct((at + 2).alias("line_no"), F.concat(F.lit("GF "), F.col("o_orderpriority")).alias("text")),
        F.struct((at + 3).alias("line_no"), F.lit("note").alias("text")))
    return o.select(F.col("o_custkey").cast("string").alias("date"), F.explode(rows).alias("r")).select(
        "date", "r.line_no", "r.text")


def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four key/value rows per customer."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    rows = F.array(*[
        F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in
        [("Name", F.col("c_name")), ("Nation", F.col("c_nationkey").cast("string")),
         ("Segment", F.col("c_mktsegment")), ("Operator", F.concat(F.lit("op"), F.col("c_nationkey").cast("string")))]])
    return c.select(F.col("c_custkey").cast("string").alias("date"), F.explode(rows).alias("r")).select("date", "r.*")


def comment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comments sheet per date: three lines per mark, label two lines below the time."""
    m = marks(spark, sf_dir)
    per_date = m.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("time_h", "label"))).alias("m"))
    lines = F.flatten(F.transform("m", lambda x: F.array(
        F.concat(F.lit("<Mark> Time: "), x["time_h"].cast("string")), F.lit(""), x["label"])))
    path = F.concat(F.lit("rawdata/RUN_"), F.lit("99000"), F.substring("date", 4, 1), F.lit("_MFT_1.xls/Comments.csv"))
    return per_date.select(path.alias("path"), F.array_join(lines, "\n").alias("content"))


def twin_detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details sheets of customers, two workbooks to a date."""
    texts = detail_texts(spark, sf_dir)
    key = F.regexp_extract("path", "RUN_([0-9]+)_", 1).cast("long")
    return texts.withColumn("path", F.concat(F.lit("rawdata/RUN_"), _digits(F.floor(key / 2)), F.lit("_MFT_"),
                                             (key % 2 + 1).cast("string"), F.lit(".xls/Details.csv")))


def detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A details sheet per customer: a title line and ten rows, of which eight count."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    day = F.concat(F.lit("2013-12-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"))
    values = [F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey"), F.lit("a"), F.lit("b"),
              F.lit("c"), day, F.lit("not read"), F.lit("not read")]
    lines = F.array(F.lit("Parameter,Value"),
                    *[F.concat(F.lit(f"key{i},"), v.cast("string")) for i, v in enumerate(values, 1)])
    path = F.concat(F.lit("rawdata/RUN_"), _digits(F.col("c_custkey")), F.lit("_MFT_1.xls/Details.csv"))
    return c.select(path.alias("path"), F.array_join(lines, "\n").alias("content"))


# --- the same tables for the oracle -------------------------------------------------------------------

SQL_READINGS = """readings as (
  select 'exp' || cast(user_id % 10 as varchar) as date,
         chr(cast(65 + (user_id // 10) % 8 as integer)) || cast((user_id // 10) // 8 + 1 as varchar) as well,
         case event_type when 'view' then 'Z' when 'click' then 'R' when 'signup' then 'C'
                         when 'purchase' then 'Rb' else 'Alpha' end as param,
         cast(case event_id % 3 when 0 then 1000 when 1 then 2000 else 4000 end as integer) as freq,
         (epoch_us(ts) - 1704067200000000) / 36000000000.0::double as time_h,
         value
  from events)"""

SQL_UNITS = """units as (
  select 'exp' || cast(d as varchar) as date,
         chr(cast(65 + w % 8 as integer)) || cast(w // 8 + 1 as varchar) as well, d, w,
         case d % 3 when 0 then 'VEGF' when 1 then 'bFGF' else 'FBS_5' end as gf
  from (select distinct user_id % 10 as d, user_id // 10 as w from events))"""

SQL_ANNOTATIONS = SQL_UNITS + """, annotations as (
  select date, well, 'GF' as layer, gf as value from units
  union all select date, well, 'conc_GF', case when gf = 'FBS_5' or w % 3 = 0 then '0' when w % 3 = 1 then '8' else '25' end from units
  union all select date, well, 'treatment', case w % 4 when 0 then 'hIgG-Fc' when 1 then 'SB101-Fc' when 2 then 'SCR' else 'siCD44' end from units
  union all select date, well, 'doses_treatment', case w % 5 when 0 then '0' when 1 then '400' when 2 then '1265' when 3 then '4000' else '999.5' end from units
  union all select date, well, 'celldensity', case when w % 15 = 14 then '10000' else '5000' end from units
  union all select date, well, 'serum', 'FBS' from units where d % 2 = 0)"""

SQL_WIDE = SQL_ANNOTATIONS + """, wide as (
  select date, well, max(value) filter (layer = 'GF') as gf, max(value) filter (layer = 'conc_GF') as conc_gf,
         max(value) filter (layer = 'treatment') as treatment, max(value) filter (layer = 'doses_treatment') as doses_treatment,
         max(value) filter (layer = 'celldensity') as celldensity, max(value) filter (layer = 'serum') as serum
  from annotations group by date, well)"""

# After the wide view: what wells carry beside its named layers.
SQL_OTHERS = """others as (
  select date, well, string_agg(layer || '=' || value, ',' order by layer) as others from (
    select date, well, 'passage' as layer, 'P' || cast(w % 4 + 3 as varchar) as value from units where d % 2 = 1
    union all select date, well, 'medium', 'M199' from units where w % 2 = 0) group by date, well)"""

SQL_MARKS = """marks as (
  with d as (select distinct user_id % 10 as d from events)
  select 'exp' || cast(d as varchar) as date, (80 + d) / 10.0::double as time_h, 'Starv' as label from d
  union all select 'exp' || cast(d as varchar), (200 + d) / 10.0::double, 'Preinc' from d where d % 5 <> 4
  union all select 'exp' || cast(d as varchar), (240 + d) / 10.0::double, 'GF added' from d)"""

SQL_SPOILED = """spoiled as (
  select date, case when date = 'exp6' and label = 'Preinc' then null when date = 'exp7' and label = 'Starv' then -0.5::double else time_h end as time_h,
         label from marks where date <> 'exp5' and (date <> 'exp1' or label = 'Starv')
  union all select date, 30.0::double, 'extra' from marks where date = 'exp2' and label = 'Starv'
  union all select date, time_h, 'again' from marks where date = 'exp4' and label = 'Starv')"""

SQL_MODELLED = """modelled as (
  select date, well, param, time_h, value, value % 1 as drift, value / 100 as rmse
  from readings where param in ('Rb', 'Alpha'))"""

# Phase of a reading: how many of its date's marks lie strictly before it.
SQL_PHASED = """phased as (
  select * exclude (k, n),
         case when time_h <= 0 then null
              when n = 2 then case k when 0 then 'Seed' when 1 then 'Starv' else 'Release' end
              when n = 3 then case k when 0 then 'Seed' when 1 then 'Starv' when 2 then 'Preinc' else 'Release' end
         end as mark
  from (select r.*, (select count(*) from marks m where m.date = r.date and m.time_h < r.time_h) as k,
               (select count(*) from marks m where m.date = r.date) as n
        from readings r))"""

SQL_WELLS = """wells as (
  select c * 8 + r as i, chr(65 + r) || cast(c + 1 as varchar) as well
  from (select cast(unnest(range(12)) as integer) as c), (select cast(unnest(range(8)) as integer) as r))"""

SQL_ANN = """ann as (
  select date, well, gf, treatment, celldensity, coalesce(serum, 'FBS') as serum, try_cast(conc_gf as double) as conc,
         try_cast(doses_treatment as double) as dose from wide)"""

SQL_RELEASE = """rel as (
  select p.*, a.* exclude (date, well) from phased p join ann a on p.date = a.date and p.well = a.well
  where p.mark = 'Release' and a.celldensity = '5000')"""
