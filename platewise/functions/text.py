"""Column functions that take names, paths and labels apart or put them together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of the input files.
MEASUREMENT_FILE = r"_[1,2]{1}.xls"
MODELLED_FILE = r"_RbA.csv"
LAYER_FILE = r"_[Mm]etadata_([A-Za-z]+)_*([A-Za-z]*).csv"
LAYER_FILE_STRICT = r"_Metadata"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def input_kind(path: Column | str, version: int = 2) -> Column:
    """'modelled', 'layer' or 'measurement' by file name, NULL for anything else."""
    path = _col(path)
    layer = path.rlike(LAYER_FILE_STRICT) if version == 2 else path.rlike(LAYER_FILE)
    return (
        F.when(path.rlike(MODELLED_FILE), "modelled")
        .when(layer, "layer")
        .when(path.rlike(MEASUREMENT_FILE), "measurement")
    )


#: The first six digits in a row, shorter rows of digits before them passed over.
SIX_DIGITS = r"^\D*(?:\d{1,5}\D+)*(\d{6})"

# Letters of the measured parameters.
MEASURED = ("C", "R", "Z")


def date_from_path(path: Column | str, version: int = 2) -> Column:
    """Experiment date in a path.

    Version 1: the first six digits in a row, with the century put before them, NULL if there are none.
    Version 2: the last six digits that have a character on either side, else the path unchanged. They are found from the
    path's end, its last character left out.
    """
    path = _col(path)
    if version == 1:
        found = F.regexp_extract(path, SIX_DIGITS, 1)
        return F.when(found != "", F.concat(F.lit("20"), found))
    backwards = F.substring(F.reverse(path), F.lit(2), F.greatest(F.length(path), F.lit(1)))
    found = F.regexp_extract(backwards, SIX_DIGITS + r"[\s\S]", 1)
    return F.when(found != "", F.reverse(found)).otherwise(path)


def layer_from_path(path: Column | str, version: int = 2) -> Column:
    """Layer name in a plate file's name: what stands between the last `data_` and the ending `.csv`. Version 1 takes the
    underscores out. A name of another form is left as it is."""
    path = _col(path)
    name = F.substring_index(F.substring_index(path, "data_", -1), ".csv", 1)
    plate = F.contains(path, F.lit("data_")) & F.endswith(path, F.lit(".csv"))
    return F.when(plate, F.replace(name, F.lit("_"), F.lit("")) if version == 1 else name).otherwise(path)


def _variable_parts(variable: Column | str, version: int) -> tuple[Column, Column, Column]:
    """(whether a column name is a well and a measured parameter, parted by a blank or, in version 1, a point; both)."""
    variable, mark = _col(variable), "." if version == 1 else " "
    well, param = F.substring_index(variable, mark, 1), F.substring_index(variable, mark, -1)
    whole = variable == F.concat(well, F.lit(mark), param)
    return whole & well.rlike("^[A-H][0-9]{1,2}$") & param.isin(*MEASURED), well, param


def well_from_variable(variable: Column | str, version: int = 2) -> Column:
    """The well in a column name; a name that is not a well and a parameter is left as it is."""
    sound, well, _ = _variable_parts(variable, version)
    return F.when(sound, well).otherwise(_col(variable))


def param_from_variable(variable: Column | str, version: int = 2) -> Column:
    """The parameter in a column name; another name is left as it is, or in version 1 gives NULL."""
    sound, _, param = _variable_parts(variable, version)
    return F.when(sound, param) if version == 1 else F.when(sound, param).otherwise(_col(variable))


def freq_from_sheet(sheet: Column | str, version: int = 2) -> Column:
    """Frequency in a sheet name, as an integer: the first digits in it, or in version 2 the last whole number among the words
    between its first and last one. NULL where there is none."""
    sheet = _col(sheet)
    if version == 1:
        return F.regexp_extract(sheet, r"^\D*(\d+)", 1).try_cast("int")
    words = F.split(sheet, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.try_element_at(F.filter(inner, lambda w: w.rlike("^[0-9]+$")), F.lit(-1)).try_cast("int")


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number gives NULL."""
    return _col(c).try_cast("double")


def number_label(c: Column | str) -> Column:
    """A number as people write it: 25, not 25.0; 25.5 stays."""
    text = F.call_function("format_number", _col(c), F.lit("0.###############"))
    return F.regexp_replace(text, "^-0$", "0")


def comparison_label(conc: Column | str, gf: Column | str, treatment: Column | str, renames=None) -> Column:
    """'<conc> ng/ml <GF>', a line break, '+<treatment>'; then text replacements in the given order."""
    label = F.concat(number_label(conc), F.lit(" ng/ml "), _col(gf), F.lit("\n+"), _col(treatment))
    for old, new in (renames or {}).items():
        label = F.regexp_replace(label, old, new)
    return label


def parse_date(c: Column | str) -> Column:
    """Eight-digit text, or six digits of this century, to a date; other text gives NULL."""
    c = _col(c)
    full = F.when(c.rlike("^[0-9]{8}$"), c).when(c.rlike("^[0-9]{6}$"), F.concat(F.lit("20"), c))
    return F.try_to_date(full, "yyyyMMdd")
