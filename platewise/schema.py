"""Table layouts and key lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("well", T.StringType()),
    T.StructField("param", T.StringType()),
    T.StructField("freq", T.IntegerType()),
    T.StructField("time_h", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

MARKS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("time_h", T.DoubleType()),
    T.StructField("label", T.StringType()),
])

ANNOTATIONS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("well", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("value", T.StringType()),
])

MODELLED = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("well", T.StringType()),
    T.StructField("param", T.StringType()),
    T.StructField("time_h", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

DETAILS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

SERIES = ("date", "well", "param", "freq")
MODEL_SERIES = ("date", "well", "param")
WELL = ("date", "well")

# Annotation layers in use, and their column names in the wide view.
LAYERS = {
    "GF": "gf",
    "conc_GF": "conc_gf",
    "treatment": "treatment",
    "doses_treatment": "doses_treatment",
    "celldensity": "celldensity",
    "serum": "serum",
}

# Plate geometry.
PLATE_ROWS = 8
PLATE_COLS = 12
PLATE_WELLS = PLATE_ROWS * PLATE_COLS

# Parameters of the modelled export, in file order.
MODEL_PARAMS = ("Rb", "Alpha", "CellMCap", "Drift", "RMSE")
