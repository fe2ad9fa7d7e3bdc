"""Instrument exports and plate grids as long tables.

Every reader comes in two parts: `read_texts` loads whole files as (path, content) rows, one file per row
and files spread over the cluster, and a parser turns such rows into a long table with built-in functions.
A file is one instrument's export of one experiment, a few megabytes, so it fits a row; what grows is the
number of files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.text import (
    date_from_path, freq_from_sheet, input_kind, layer_from_path, param_from_variable, to_number, well_from_variable,
)
from platewise.operators.reshape import well_name
from platewise.schema import MODEL_PARAMS, PLATE_COLS, PLATE_ROWS
from platewise.session import new_path

# Sheets that hold no readings.
OTHER_SHEETS = ("Details", "Comments")

# Line positions in modelled exports, counted from 0.
MODELLED_PARAM_LINE = 19
MODELLED_WELL_LINE = 20
MODELLED_FIRST_DATA_LINE = 23


def list_inputs(spark: SparkSession, root: str, kind: str | None = None, version: int = 2) -> DataFrame:
    """(path, kind) of the input files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path").withColumn("kind", input_kind("path", version))
    )
    return files.where(F.col("kind").isNotNull() if kind is None else F.col("kind") == kind)


def read_texts(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, content): one row per file."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path if isinstance(path, str) else list(path), wholetext=True, recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _lines(content: Column | str) -> Column:
    text = F.regexp_replace(content, "\r\n?", "\n")
    return F.split(F.regexp_replace(text, "\n+$", ""), "\n")


def _cells(line: Column) -> Column:
    """Cells of a line; a comma between double quotes does not end one."""
    quoted = F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'),
                         lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(
        F.transform(F.split(line, ","), lambda x: F.trim(x)))


# --- wide sheets ------------------------------------------------------------------------------------

def data_sheets(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Rows of the sheets that hold readings."""
    return df.where(~F.col(sheet).isin(*OTHER_SHEETS))


def sheet_from_path(path: Column | str) -> Column:
    """Sheet name of a sheet's CSV: the file name without its ending."""
    path = F.col(path) if isinstance(path, str) else path
    return F.replace(F.regexp_extract(path, "([^/]+)\\.csv$", 1), F.lit("%20"), F.lit(" "))


def workbook_date(path: Column | str, version: int = 2) -> Column:
    """Date of a sheet's CSV: it stands in the folder that represents the workbook."""
    path = F.col(path) if isinstance(path, str) else path
    return date_from_path(F.regexp_replace(path, "/[^/]+$", ""), version)


def workbook_of(path: Column | str) -> Column:
    """Which workbook a sheet's CSV is of: the name of the folder it lies in. A date may have several."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def sheets_to_long(texts: DataFrame) -> DataFrame:
    """(path, sheet, time_h, variable, value): one row per cell of every sheet CSV, each with its own header."""
    sheets = data_sheets(texts.withColumn("sheet", sheet_from_path("path")))
    whole = sheets.select("path", "sheet", _lines("content").alias("_lines"))
    headed = whole.select("path", "sheet", _cells(F.element_at("_lines", 1)).alias("_names"), "_lines")
    cells = _zipped(headed, ["path", "sheet"], {"variable": "_names"}, 1)
    return cells.select("path", "sheet", "time_h", "variable", to_number("_text").alias("value"))


def _zipped(headed: DataFrame, keep: Sequence[str], heads: Mapping[str, str], first: int) -> DataFrame:
    """(keep, time_h, a column per head, _at, _text): a row per cell of the lines from number `first` on, the line's first
    cell being its time.

    The heads are arrays made once per file, below the explode of lines. Each line is zipped with them before its
    cells are exploded, so that a cell carries its own names and not the arrays. Cells beyond a head get a missing name.
    """
    names = list(heads.values())
    lines = headed.select(*keep, *names, F.posexplode("_lines").alias("_no", "_line")).where(F.col("_no") >= first)
    rows = lines.select(*keep, *names, _cells(F.col("_line")).alias("_row"))
    each = F.transform("_row", lambda x, i: F.struct(
        i.alias("_at"), x.alias("_text"), *[F.get(F.col(a), i).alias(name) for name, a in heads.items()]))
    zipped = rows.select(*keep, to_number(F.element_at("_row", 1)).alias("time_h"),
                         F.explode(F.slice(each, F.lit(2), F.greatest(F.size("_row") - 1, F.lit(0)))).alias("_cell"))
    return zipped.select(*keep, "time_h", "_cell.*")


def unpivot_readings(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Wide sheet to (id_cols, variable, value)."""
    return df.unpivot(list(id_cols), None, "variable", "value")


def split_variable(df: DataFrame, version: int = 2, variable: str = "variable") -> DataFrame:
    return df.withColumn("well", well_from_variable(variable, version)).withColumn(
        "param", param_from_variable(variable, version))


def readings_from_sheets(texts: DataFrame, version: int = 2, identity: bool = False) -> DataFrame:
    """Sheet CSVs to the readings table, with `identity` beside the workbook that each comes from.

    Names are taken apart once per file and column, before the file's cells become rows.
    """
    more = ["workbook"] if identity else []
    sheets = data_sheets(texts.withColumn("sheet", sheet_from_path("path")))
    headed = sheets.select(
        workbook_date("path", version).alias("date"), freq_from_sheet("sheet", version).alias("freq"),
        *([workbook_of("path").alias("workbook")] if identity else []), _lines("content").alias("_lines")).withColumn(
        "_names", _cells(F.element_at("_lines", 1)))
    named = headed.withColumn("_wells", F.transform("_names", lambda x: well_from_variable(x, version))).withColumn(
        "_params", F.transform("_names", lambda x: param_from_variable(x, version)))
    cells = _zipped(named, ["date", "freq", *more], {"well": "_wells", "param": "_params"}, 1)
    return cells.select("date", "well", "param", "freq", "time_h", to_number("_text").alias("value"), *more)


# --- comments and details ---------------------------------------------------------------------------

def parse_marks(comments: DataFrame) -> DataFrame:
    """Marks among numbered comment lines (date, line_no, text): the time stands in the mark's own line after
    ': ', its label two lines below. A workbook's comments are few; lines are looked up by number, inside their file
    where there is a `path`, since a date may have several workbooks."""
    keys = [c for c in ("path", "date", "workbook") if c in comments.columns]
    marks = comments.where(F.col("text").contains("<Mark>")).select(
        *keys, F.col("line_no").alias("_at"), to_number(F.element_at(F.split("text", ": "), 2)).alias("time_h"))
    labels = comments.select(*keys, (F.col("line_no") - 2).alias("_at"), F.col("text").alias("label"))
    more = ["workbook"] if "workbook" in keys else []
    return marks.join(labels, [*keys, "_at"], "left").select("date", "time_h", "label", *more)


def comment_lines(texts: DataFrame, version: int = 2, identity: bool = False) -> DataFrame:
    """Comment sheet CSVs to numbered lines, with `identity` beside their workbook."""
    comments = texts.where(sheet_from_path("path") == "Comments")
    return comments.select(
        "path", workbook_date("path", version).alias("date"), *([workbook_of("path").alias("workbook")] if identity else []),
        F.posexplode(_lines("content")).alias("line_no", "text"))


def detail_pairs(texts: DataFrame, version: int = 2, n: int = 8, skip: int = 1, identity: bool = False) -> DataFrame:
    """(date, key, value, pos) of the first n rows of every details sheet, `skip` title lines left out; with `identity`
    also `workbook`, by which the details of two workbooks of one date stay apart."""
    more = ["workbook"] if identity else []
    details = texts.where(sheet_from_path("path") == "Details")
    lines = details.select(
        workbook_date("path", version).alias("date"), *([workbook_of("path").alias("workbook")] if identity else []),
        F.posexplode(_lines("content")).alias("_no", "_line"))
    cells, pos = _cells(F.col("_line")), F.col("_no") - skip + 1
    return lines.where(pos.between(1, n)).select(
        "date", F.try_element_at(cells, F.lit(1)).alias("key"), F.try_element_at(cells, F.lit(2)).alias("value"),
        pos.alias("pos"), *more)


def date_from_details(pairs: DataFrame, pos: int = 8) -> DataFrame:
    """(date, recorded): the recording date that the details give, blanks and dashes removed."""
    return pairs.where(F.col("pos") == pos).select("date", F.regexp_replace("value", "[ -]", "").alias("recorded"))


def details_wide(details: DataFrame, names: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """One row per date (per workbook where `details` name it), one column per key."""
    names = dict(names) if isinstance(names, Mapping) else {x: x for x in names}
    return details.groupBy("date", *[c for c in ("workbook",) if c in details.columns]).agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(out) for k, out in names.items()])


# --- plate grids ------------------------------------------------------------------------------------

def plate_to_long(texts: DataFrame, version: int = 2) -> DataFrame:
    """Plate-shaped CSVs to (date, well, layer, value): line to letter, position to number, all text.

    Cells that hold nothing, and wells that the grid leaves out, are NULL.
    """
    parsed = texts.select(
        date_from_path("path", version).alias("date"), layer_from_path("path", version).alias("layer"),
        F.transform(_lines("content"), _cells).alias("_grid"))
    grid = parsed.select("date", "layer", "_grid", F.explode(F.sequence(F.lit(0), F.lit(PLATE_ROWS * PLATE_COLS - 1))).alias("_i"))
    row, col = F.floor(F.col("_i") / PLATE_COLS).cast("int"), (F.col("_i") % PLATE_COLS).cast("int")
    text = F.try_element_at(F.try_element_at("_grid", row + 1), col + 1)
    return grid.select("date", well_name(row, col).alias("well"), "layer", F.nullif(text, F.lit("")).alias("value"))


def read_plate_layers(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    return plate_to_long(read_texts(spark, path, "*etadata_*.csv"), version)


def annotations_wide(annotations: DataFrame, layers: Sequence[str], glue_names: bool = True) -> DataFrame:
    """(date, well, one column per layer); with `glue_names` the layers' underscores are dropped from names."""
    return annotations.groupBy("date", "well").agg(*[
        F.max(F.when(F.col("layer") == x, F.col("value"))).alias(x.replace("_", "") if glue_names else x)
        for x in layers])


def union_layers(dfs: Sequence[DataFrame], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Stack wide annotation tables of differing layers; gaps become NULL, then defaults fill theirs."""
    defaults = {"serum": "FBS"} if defaults is None else defaults
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    here = {k: v for k, v in defaults.items() if k in out.columns}
    return out.na.fill(here) if here else out


# --- modelled parameters ----------------------------------------------------------------------------

def _modelled_cells(texts: DataFrame, version: int) -> DataFrame:
    headed = texts.select(date_from_path("path", version).alias("date"), _lines("content").alias("_lines")).select(
        "date", _cells(F.try_element_at("_lines", F.lit(MODELLED_PARAM_LINE + 1))).alias("_params"),
        _cells(F.try_element_at("_lines", F.lit(MODELLED_WELL_LINE + 1))).alias("_wells"), "_lines")
    return _zipped(headed, ["date"], {"param": "_params", "well": "_wells"}, MODELLED_FIRST_DATA_LINE)


def read_modelled_v1(texts: DataFrame) -> DataFrame:
    """Modelled exports by position: time, then five parameters per well, wells down the columns of the plate.

    (date, well, time_h, drift, rmse, param, value): drift and rmse stand beside Rb, Alpha and CellMCap.
    """
    cells = _modelled_cells(texts, 1)
    at, k = F.col("_at") - 1, len(MODEL_PARAMS)
    well_no = F.floor(at / k).cast("int")
    long = cells.select(
        "date",
        well_name(well_no % PLATE_ROWS, F.floor(well_no / PLATE_ROWS).cast("int")).alias("well"), "time_h",
        F.element_at(F.array(*[F.lit(p) for p in MODEL_PARAMS]), (at % k + 1).cast("int")).alias("param"),
        to_number("_text").alias("value"))
    wide = long.groupBy("date", "well", "time_h").agg(
        *[F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in MODEL_PARAMS])
    return wide.withColumnsRenamed({"Drift": "drift", "RMSE": "rmse"}).unpivot(
        ["date", "well", "time_h", "drift", "rmse"], ["Rb", "Alpha", "CellMCap"], "param", "value")


def read_modelled_v2(texts: DataFrame) -> DataFrame:
    """Modelled exports by their two header lines (parameters, wells): (date, well, param, time_h, value)."""
    cells = _modelled_cells(texts, 2)
    return cells.select("date", "well", "param", "time_h", to_number("_text").alias("value"))


# --- everything -------------------------------------------------------------------------------------

# Names of the files of each kind, as globs.
KIND_GLOBS = {"sheet": "*.csv", "layer": "*etadata_*.csv", "modelled": "*_RbA.csv"}


def ingest_folder(spark: SparkSession, root: str, version: int = 2, identity: bool = False) -> dict[str, DataFrame]:
    """All tables from the files below a folder. Plate grids and modelled exports are picked by name before they are read,
    so a table opens the files of its own kind only, and the workbooks' sheets are told apart by folder."""
    return ingest(read_texts(spark, root, KIND_GLOBS["sheet"]), version, identity,
                  layers=read_texts(spark, root, KIND_GLOBS["layer"]), modelled=read_texts(spark, root, KIND_GLOBS["modelled"]))


def sorted_texts(texts: DataFrame, version: int = 2) -> DataFrame:
    """(path, content, kind), written once in a folder per kind, so that a reader of one kind opens its own rows only: the
    kinds of `input_kind`, and for a measurement's sheets `readings`, `Comments` or `Details`. Other rows are left out.

    Kinds are told by file. The outer explode keeps that from being done again, below, for every row that a file is made of.
    """
    sheet, kind = sheet_from_path("path"), input_kind("path", version)
    kinds = F.array(
        F.when(input_kind(_workbook_path(), version) == "measurement",
               F.when(sheet.isin(*OTHER_SHEETS), sheet).otherwise("readings")),
        F.when(kind.isin("layer", "modelled"), kind))
    told = texts.select("path", "content", F.explode_outer(F.array_compact(kinds)).alias("kind")).where("kind is not null")
    spark, path = texts.sparkSession, new_path(texts.sparkSession, "texts")
    told.write.mode("error").partitionBy("kind").parquet(path)
    return spark.read.schema(told.schema).parquet(path)


def _workbook_path() -> Column:
    return F.regexp_extract("path", "^(.+\\.xlsx?)/[^/]+\\.csv$", 1)


def ingest(texts: DataFrame, version: int = 2, identity: bool = False, layers: DataFrame | None = None,
           modelled: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables from one set of (path, content) rows, by file kind; `layers` and `modelled` hold the rows of these kinds
    where they are read apart. With `identity`, readings, marks and details name their workbook.

    One set of all kinds is sorted by kind first (`sorted_texts`), which reads it once and not once per table.
    """
    if layers is None and modelled is None:
        told = sorted_texts(texts, version)
        readings, comments, sheets, layers, modelled = (
            told.where(F.col("kind") == k) for k in ("readings", "Comments", "Details", "layer", "modelled"))
    else:
        kind = input_kind("path", version)
        sheets = texts.where(input_kind(_workbook_path(), version) == "measurement")
        readings = comments = sheets
        layers = (texts if layers is None else layers).where(kind == "layer")
        modelled = (texts if modelled is None else modelled).where(kind == "modelled")
    more = ["workbook"] if identity else []
    return {
        "readings": readings_from_sheets(readings, version, identity),
        "marks": parse_marks(comment_lines(comments, version, identity)),
        "details": detail_pairs(sheets, version, identity=identity).select("date", "key", "value", *more),
        "annotations": plate_to_long(layers, version),
        "modelled": read_modelled_v1(modelled) if version == 1 else read_modelled_v2(modelled),
    }
