"""Row filters and recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.text import number_label, to_number

# Names used in published figures.
TREATMENT_RENAMES = {"SCR": "siNTP"}
LABEL_RENAMES_V1 = {"SB101": "3MUT"}
LABEL_RENAMES_V2 = {"SB101": "3MUT", "hIgG": "rhIgG"}
SIRNA_LEVELS = ("siNTP", "siCD44", "siVIM", "UT")
SIRNA_LEVELS_NO_UT = ("siNTP", "siCD44", "siVIM")
GF_LABELS = {"FBS_5": "5% FBS", "FBS_20": "20% FBS", "VEGF": "VEGF", "bFGF": "FGF2", "GDF-2": "GDF-2"}

# Parameter, display name, unit.
PARAMETERS = (
    ("Z", "impedance", "Ohm"),
    ("R", "resistance", "Ohm"),
    ("C", "capacitance", "F"),
    ("Rb", "barrier resistance", "Ohm.cm^2"),
    ("Alpha", "alpha", "Ohm^0.5.cm"),
    ("CellMCap", "cell membrane capacitance", "uF/cm^2"),
)


def select_readings(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a list means membership, None means no condition."""
    for name, want in wanted.items():
        if want is None:
            continue
        df = df.where(F.col(name).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(name) == want)
    return df


def exclude_dates(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    return df.where(~F.col("date").isin(list(dates))) if dates else df


def exclude_first_date(df: DataFrame) -> DataFrame:
    return df.where(F.col("date") != df.agg(F.min("date")).scalar())


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value; NaN counts as missing."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Columns with more than one distinct value, a missing value counting as one.

    The result's schema depends on the data, so this runs one aggregate over `df` at once.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"n{i}")]
    s = df.agg(*aggs).first()
    keep = [c for i, c in enumerate(df.columns)
            if s[f"n{i}"] and (s[f"lo{i}"] != s[f"hi{i}"] or s[f"n{i}"] < s["n"])]
    return df.select(*keep)


def effective_doses(df: DataFrame, col: str = "dose", min_dose: float = 1000, ceil_first: bool = False) -> DataFrame:
    """Doses of zero or above the threshold, rounded up to whole numbers."""
    up = F.ceil(F.col(col)).cast("double")
    if ceil_first:
        df = df.withColumn(col, up)
    df = df.where((F.col(col) == 0) | (F.col(col) > min_dose))
    return df if ceil_first else df.withColumn(col, up)


def numeric_annotations(df: DataFrame) -> DataFrame:
    """Text concentration and dose as numbers: columns `conc` and `dose`."""
    return df.withColumn("conc", to_number("conc_gf")).withColumn("dose", to_number("doses_treatment")).drop(
        "conc_gf", "doses_treatment")


def recode(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[col])


def relevel(df: DataFrame, col: str, levels: Sequence, labels: Mapping | None = None) -> DataFrame:
    """Values outside `levels` become NULL, labels replace levels, `<col>_ord` keeps the display order."""
    source = F.col(col)
    order = value = None
    for i, level in enumerate(levels, 1):
        text = F.lit((labels or {}).get(level, level))
        order = F.when(source == level, i) if order is None else order.when(source == level, i)
        value = F.when(source == level, text) if value is None else value.when(source == level, text)
    return df.withColumn(f"{col}_ord", order).withColumn(col, value)


def unit_labels(df: DataFrame, col: str, unit: str) -> DataFrame:
    """A number column as '<n> <unit>' text, keeping the number in `<col>_ord`."""
    return df.withColumn(f"{col}_ord", F.col(col)).withColumn(
        col, F.concat(number_label(F.col(col).cast("double")), F.lit(f" {unit}")))


def mark_untreated(df: DataFrame, treatment: str = "treatment", dose: str = "dose") -> DataFrame:
    return df.withColumn(treatment, F.when(F.col(dose) > 0, F.col(treatment)).otherwise("untreated"))


def legend_label(conc: Column | str, gf: Column | str, treatment: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in (gf, treatment)]
    return F.concat(number_label(conc), F.lit("-"), parts[0], F.lit("-"), parts[1])


def group_label(df: DataFrame, keys: Sequence[str], conc: str = "conc", gf: str = "gf") -> DataFrame:
    """(keys, group_label): '<gf>-<conc>' of the second distinct combination, or of the only one."""
    combos = df.select(*keys, gf, conc).distinct()
    w = Window.partitionBy(*keys)
    ranked = combos.withColumn("_i", F.row_number().over(w.orderBy(conc, gf))).withColumn(
        "_n", F.count(F.lit(1)).over(w))
    label = F.concat(F.col(gf), F.lit("-"), number_label(conc))
    return ranked.where(F.col("_i") == F.least(F.lit(2), F.col("_n"))).select(*keys, label.alias("group_label"))


def param_info(spark: SparkSession) -> DataFrame:
    """Display name and unit of each parameter: six fixed rows."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("param", "param_name", "unit")])
    return spark.createDataFrame(list(PARAMETERS), schema)


def with_param_info(df: DataFrame) -> DataFrame:
    """The fixed six-row table is the one side that is always broadcast."""
    return df.join(F.broadcast(param_info(df.sparkSession)), "param", "left")
