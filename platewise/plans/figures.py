"""The data tables behind the published figures, end to end.

Shared shape. Readings meet only tables with one row per experiment (phases, starts), which are small enough
to be broadcast at almost any scale. They are then reduced to hourly cells, or to the first rows of each
series, and only those meet the annotations, which have one row per well. Bins, baselines, means and pairs
are made from cells. Tables that feed several later steps are written once (`materialise`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.numbers import DOSE_BREAKS, cut_breaks, pool_values, safe_ratio, to_micromolar, to_places, unlog
from platewise.functions.text import comparison_label
from platewise.operators.joins import (
    annotate, attach, dates_with, dates_with_treated, keep_dates, pairs, replicated_series, widen_annotations,
)
from platewise.operators.normalise import DIVIDE, baseline, normalise
from platewise.operators.recode import (
    GF_LABELS, LABEL_RENAMES_V1, LABEL_RENAMES_V2, SIRNA_LEVELS, SIRNA_LEVELS_NO_UT, TREATMENT_RENAMES, complete_cases,
    effective_doses, exclude_dates, exclude_first_date, group_label, legend_label, mark_untreated, numeric_annotations,
    recode, relevel, select_readings,
)
from platewise.operators.rows import edge_rows
from platewise.operators.summary import cell_mean, cells_mean_se, histogram, mean_by, mean_se, summarise_experiments
from platewise.operators.timeline import (
    align_right, clip_time, common_length, hour_bins, hour_breaks, hourly_cells, marks_wide, rebase_to,
    rebase_to_mark, release_time, replicated_horizon, segment_by_cuts, sound_marks, start_times,
)
from platewise.schema import LAYERS, MODEL_SERIES, SERIES, WELL
from platewise.session import materialise

# Fixed value: the treatment that marks an experiment as a silencing one.
SILENCER = "siCD44"

# Growth factors shown together in one panel.
SIRNA_PANELS = {"VEGF": ("VEGF", "FBS_5"), "FGF2": ("bFGF", "FBS_5")}
SPECTRUM_PANELS = {"VEGF": ("VEGF", "FBS_5"), "bFGF": ("bFGF", "FBS_5"), "GDF-2": ("GDF-2", "FBS_5"),
                   "FBS": ("FBS_20", "FBS_5")}
EARLY_PANELS = {"VEGF": ("VEGF", "FBS_5"), "bFGF": ("bFGF", "FBS_5"), "FBS": ("FBS_20", "FBS_5")}


# --- shared steps -----------------------------------------------------------------------------------

def wide_annotations(annotations: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Wide annotations with numeric `conc` and `dose`, and `full`: whether the well has every layer that any of the
    given experiments has (whatever its name; layers with a default count as there).

    So the caller restricts to its experiments first. The layers are counted by a small job.
    """
    wide = widen_annotations(annotations, defaults=defaults, names="layers", others=None)
    filled = [layer for layer, name in LAYERS.items() if name in (defaults or {})]
    total = annotations.where("value is not null").select("layer").where(~F.col("layer").isin(filled)).distinct().count()
    own = F.size(F.array_except("layers", F.array(*[F.lit(x) for x in filled]).cast("array<string>")))
    return numeric_annotations(wide.withColumn("full", own == F.lit(total)).drop("layers"))


def of_class(experiments: DataFrame | None, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables' rows of the given experiments (a `date` column), or all rows. Readings partitioned by date are pruned."""
    return tables if experiments is None else tuple(keep_dates(t, experiments) for t in tables)


def plates(annotations: DataFrame, marks: DataFrame, carrier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Wide annotations and the marks of each date in one row: written once, read by every later step. With `carrier`,
    only experiments that carry that annotation value: their class."""
    if carrier is not None:
        annotations = keep_dates(annotations, dates_with(annotations, carrier))
    wide = materialise(wide_annotations(annotations, {"serum": "FBS"}), "wide")
    return wide, materialise(marks_wide(sound_marks(marks)), "cuts")


def phase_rows(readings: DataFrame, cuts: DataFrame, phases: Sequence[str] = ("Release",), **wanted) -> DataFrame:
    """Readings of the chosen phases. Dates without sound marks are set aside; `refused_dates` names them."""
    phased = segment_by_cuts(select_readings(readings, **wanted), cuts, on_invalid="drop")
    return phased.where(F.col("mark").isin(list(phases))).drop("mark")


def starts_of(rows: DataFrame, wells: DataFrame) -> DataFrame:
    """(date, start_h): first time of any of the wells. Times are reduced to one per well before the wells are joined."""
    per_well = rows.groupBy(*WELL).agg(F.min("time_h").alias("time_h"))
    return materialise(start_times(keep_wells(per_well, wells)), "starts")


def keep_wells(df: DataFrame, wells: DataFrame) -> DataFrame:
    return df.join(wells.select(*WELL), list(WELL), "left_semi")


def release_rows(readings: DataFrame, annotations: DataFrame, marks: DataFrame, density: str | None = "5000",
                 serum: str | None = None, carrier: str | None = None, **wanted) -> tuple[DataFrame, DataFrame]:
    """(readings after release, by time from their experiment's first one; the annotated wells they belong to).

    The readings are not yet limited to those wells: joining cells with the wells does that.
    """
    wide, cuts = plates(annotations, marks, carrier)
    wells = select_readings(wide, celldensity=density, serum=serum)
    rows = phase_rows(readings, cuts, **wanted)
    return rebase_to(rows, starts_of(rows, wells)), wells


def release_heads(readings: DataFrame, annotations: DataFrame, marks: DataFrame, series: Sequence[str], n: int = 3,
                  known: bool = False, density: str | None = "5000", carrier: str | None = None,
                  **wanted) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `release_rows`, and third the first n rows of each of the `series` (with `known`, those that have a value), by the
    same time. One pass over the readings finds these rows and, as a series starts with its first row, the starts; so
    a figure reads the readings twice, here and for its cells."""
    wide, cuts = plates(annotations, marks, carrier)
    wells = select_readings(wide, celldensity=density)
    rows = phase_rows(readings, cuts, **wanted)
    # rows without a value count for the start; they are numbered apart where only values are wanted
    kind = F.col("value").isNull() if known else F.lit(False)
    heads = materialise(edge_rows(rows.select(*series, "time_h", "value", kind.alias("_none")), [*series, "_none"], n), "heads")
    starts = starts_of(heads, wells)
    first = rebase_to(heads.where(~F.col("_none")), starts).drop("rn", "_none")
    return rebase_to(rows, starts), wells, first


def scale_cells(cells: DataFrame, base: str) -> DataFrame:
    """Cells divided by their series' baseline; without a usable baseline they count as missing."""
    scaled = cells.withColumn("total", safe_ratio("total", base))
    if "m2" in cells.columns:
        scaled = scaled.withColumn("m2", safe_ratio("m2", F.col(base) * F.col(base)))
    return scaled.withColumn("n", F.when(F.col("total").isNotNull(), F.col("n")).otherwise(F.lit(0)))


def shift_cells(cells: DataFrame, base: str) -> DataFrame:
    """Cells minus their series' baseline; without one they count as missing."""
    moved = cells.withColumn("total", F.col("total") - F.col("n") * F.col(base))
    return moved.withColumn("n", F.when(F.col(base).isNotNull(), F.col("n")).otherwise(F.lit(0)))


def with_panels(df: DataFrame, panels: Mapping[str, Sequence[str]], gf: str = "gf") -> DataFrame:
    """A row per panel its growth factor belongs to."""
    names = F.array(*[F.when(F.col(gf).isin(list(members)), F.lit(p)) for p, members in panels.items()])
    return df.withColumn("panel", F.explode(F.filter(names, lambda x: x.isNotNull())))


def treat_labels(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumn("treat2", comparison_label("conc", "gf", "treatment", renames))


# --- treatments after release -----------------------------------------------------------------------

def paired_release(readings: DataFrame, annotations: DataFrame, marks: DataFrame, series: Sequence[str] = WELL,
                   max_time: float = 73, min_dose: float = 1000, exclude: Sequence[str] = (),
                   param=None, freq=None, carrier: str | None = None,
                   experiments: DataFrame | None = None) -> DataFrame:
    """Experiment means per hour of wells relative to their first three readings, in control/induced pairs. With
    `carrier`, only of the experiments that carry that annotation value; with `experiments`, only of these."""
    readings, annotations, marks = of_class(experiments, readings, annotations, marks)
    rows, wells, heads = release_heads(exclude_dates(readings, exclude), annotations, marks, series, carrier=carrier,
                                       param=param, freq=freq)
    rows, heads = clip_time(rows, hi=max_time), clip_time(heads, hi=max_time)
    keys = ["conc", "dose", "gf", "treatment"]
    cells = annotate(hourly_cells(rows, SERIES), effective_doses(wells, min_dose=min_dose).select(*WELL, *keys))
    binned = hour_bins(cells, series, hour="hour", on_break="on_break", windowed=True).where("time_bin is not null")
    scaled = scale_cells(attach(binned, baseline(heads, series, "div_head"), series), "base")
    means = scaled.groupBy("freq", "param", "date", *keys, "time_bin").agg(cell_mean(na_rm=False).alias("value"))
    labelled = treat_labels(mark_untreated(materialise(means, "means")), LABEL_RENAMES_V1)
    return dates_with_treated(pairs(labelled, ["gf"]), ["gf", "pair_ind"])


def release_summary(readings: DataFrame, annotations: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """Mean, sd, n, se over experiments of every pair, dose and hour after release."""
    paired = paired_release(readings, annotations, marks, **options)
    return summarise_experiments(
        paired, ["freq", "param", "gf", "pair_ind", "conc", "dose", "time_bin", "treat2"])


def release_all_frequencies(readings: DataFrame, annotations: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """Mean and standard error for every parameter and frequency."""
    paired = paired_release(readings, annotations, marks, series=("well", "date", "param", "freq"), **options)
    return mean_se(paired, ["param", "freq", "gf", "pair_ind", "dose", "treat2", "time_bin"])


def pre_release_summary(readings: DataFrame, annotations: DataFrame, marks: DataFrame, gf: str = "VEGF",
                        ind: float = 25, param=None, freq=None, min_dose: float = 1000, first_bin: int = -40,
                        max_time: float = 73, exclude: Sequence[str] = (), carrier: str | None = None,
                        experiments: DataFrame | None = None) -> DataFrame:
    """Hours before release, relative to the last three readings, over the experiments of one pair."""
    readings, annotations, marks = of_class(experiments, readings, annotations, marks)
    wide, cuts = plates(annotations, marks, carrier)
    wells = select_readings(wide, celldensity="5000")
    # The pair's experiments: those with a treated well that has readings after release.
    after = phase_rows(exclude_dates(readings, exclude), cuts, param=param, freq=freq)
    after = clip_time(rebase_to(after, starts_of(after, wells)), hi=max_time)
    seen = keep_wells(effective_doses(wells, min_dose=min_dose), after.select(*WELL).distinct())
    levels = materialise(seen.select("gf", "conc", "dose", "date").distinct(), "levels")
    dates = (
        pairs(levels, ["gf"]).where((F.col("gf") == gf) & (F.col("pair_ind") == ind) & (F.col("dose") > 0))
        .select("date").distinct()
    )
    rows = phase_rows(readings, cuts, ("Seed", "Starv", "Preinc"), param=param, freq=freq)
    cells = materialise(keep_wells(hourly_cells(rows, SERIES), wells), "cells")
    # Bins run over the hours of all experiments together.
    breaks = materialise(hour_breaks(cells, [], "hour"), "breaks")
    binned = keep_dates(hour_bins(cells, [], hour="hour", on_break="on_break", breaks=breaks), dates)
    binned = align_right(binned.where("time_bin is not null").withColumn("ordinal", F.col("time_bin")))
    binned = binned.where(F.col("time_bin") >= first_bin)
    # Bins grow with time, so the bins kept of an experiment are one span of time: from the lower edge of its
    # first one, which belongs to it only if it is the lowest of all, to the last break.
    edges = breaks.select(F.col("_rank").alias("_first"), F.col("hour").alias("lo"))
    spans = binned.groupBy("date").agg(F.max(F.col("ordinal") - F.col("time_bin")).alias("_last")).select(
        "date", F.greatest(F.col("_last") + first_bin, F.lit(1)).alias("_first")).join(edges, "_first")
    last = breaks.agg(F.max("hour")).scalar()
    inside = (F.col("time_h") > F.col("lo")) | ((F.col("_first") == 1) & (F.col("time_h") == F.col("lo")))
    kept = attach(rows, spans, ["date"]).where(inside & (F.col("time_h") <= last))
    scaled = scale_cells(attach(binned, baseline(kept, SERIES, "div_tail"), SERIES), "base")
    means = scaled.groupBy("freq", "param", "date", "time_bin").agg(cell_mean(na_rm=False).alias("value"))
    return summarise_experiments(means, ["freq", "param", "time_bin"])


# --- treatments around release ----------------------------------------------------------------------

def paired_around_release(readings: DataFrame, annotations: DataFrame, marks: DataFrame, carrier: str = "SB101-Fc",
                          exclude: Sequence[str] | None = None, param=None, freq=None,
                          min_dose: float = 1000) -> DataFrame:
    """Experiment means per hour around release, relative to the hour that ends at it, in pairs.

    Experiments are those annotated with `carrier`, but for the excluded dates, or the first date when none
    are given.
    """
    dates = dates_with(annotations, carrier)
    dates = exclude_first_date(dates) if exclude is None else exclude_dates(dates, exclude)
    wide = effective_doses(wide_annotations(keep_dates(annotations, dates)), min_dose=min_dose, ceil_first=True)
    release = release_time(keep_dates(marks, dates))
    rows = rebase_to_mark(keep_dates(select_readings(readings, param=param, freq=freq), dates), release)
    cells = materialise(hourly_cells(rows, SERIES), "cells")
    binned = hour_bins(cells, ["date"], out="label", hour="hour", on_break="on_break")
    kept = annotate(binned, wide.where("full")).where("time_bin is not null and n > 0")
    well, at_release = Window.partitionBy(*WELL), F.col("time_bin") == 0
    base = F.try_divide(F.sum(F.when(at_release, F.col("total"))).over(well),
                        F.sum(F.when(at_release, F.col("n"))).over(well))
    scaled = scale_cells(kept.withColumn("base", base), "base")
    keys = ["date", "conc", "dose", "gf", "treatment", "time_bin"]
    means = materialise(scaled.groupBy(*keys).agg(cell_mean().alias("value")), "means")
    labelled = treat_labels(mark_untreated(means).withColumn("dose", to_micromolar("dose")), LABEL_RENAMES_V2)
    return dates_with_treated(pairs(labelled, ["gf"]), ["gf", "pair_ind"])


def around_release_summary(readings: DataFrame, annotations: DataFrame, marks: DataFrame, **options) -> DataFrame:
    paired = paired_around_release(readings, annotations, marks, **options)
    return mean_se(paired.where(F.col("time_bin") >= 0), ["gf", "pair_ind", "dose", "treat2", "time_bin"])


def before_release_summary(readings: DataFrame, annotations: DataFrame, marks: DataFrame, **options) -> DataFrame:
    paired = paired_around_release(readings, annotations, marks, **options)
    per_date = mean_by(paired.where(F.col("time_bin") <= 0), ["gf", "pair_ind", "date", "time_bin"])
    return mean_se(per_date, ["gf", "pair_ind", "time_bin"])


# --- gene silencing ---------------------------------------------------------------------------------

def sirna_hourly(readings: DataFrame, annotations: DataFrame, marks: DataFrame, carrier: str | None = SILENCER,
                 **wanted) -> DataFrame:
    """Hourly means of silencing experiments after release, up to the last hour two experiments share."""
    rows, wells = release_rows(readings, annotations, marks, carrier=carrier, **wanted)
    keys = ["date", "gf", "conc", "param", "freq", "treatment"]
    cells = annotate(hourly_cells(rows, SERIES), wells.select(*WELL, "gf", "conc", "treatment", "full"))
    cells = materialise(cells, "cells")
    binned = hour_bins(cells, ["date"], hour="hour", on_break="on_break")
    kept = replicated_horizon(binned.where("full and time_bin is not null and n > 0"))
    means = kept.groupBy(*keys, "time_bin").agg(cell_mean().alias("value"))
    return relevel(recode(means, "treatment", TREATMENT_RENAMES), "treatment", SIRNA_LEVELS)


def sirna_summary(readings: DataFrame, annotations: DataFrame, marks: DataFrame, min_freq: int = 1000,
                  **wanted) -> DataFrame:
    hourly = sirna_hourly(readings, annotations, marks, **wanted).where(F.col("freq") >= min_freq)
    return mean_se(with_panels(hourly, SIRNA_PANELS), ["panel", "param", "freq", "conc", "treatment", "time_bin"])


def sirna_cells(values: DataFrame, annotations: DataFrame, marks: DataFrame, series: Sequence[str] = SERIES,
                carrier: str = SILENCER, mark_label: str = "GF", **wanted) -> DataFrame:
    """Hourly cells of silencing experiments, binned by hours from release, annotated, complete rows only.

    Only the wanted parameters and frequencies are reduced to cells; the hours that make the bins are those of
    all of an experiment's rows, for which dates and times alone are read.
    """
    dates = dates_with(annotations, carrier)
    release = release_time(keep_dates(marks, dates), label_like=mark_label)
    rows = rebase_to_mark(keep_dates(values, dates), release)
    cells = hourly_cells(select_readings(rows, **wanted), series)
    some = any(want is not None for want in wanted.values())
    cells = cells if some else materialise(cells, "cells")
    breaks = hour_breaks(rows.withColumn("hour", F.floor("time_h")) if some else cells, ["date"], "hour")
    binned = hour_bins(cells, ["date"], out="label", hour="hour", on_break="on_break", breaks=breaks)
    wide = wide_annotations(keep_dates(annotations, dates)).where("full")
    kept = annotate(binned, wide).where("time_bin is not null and n > 0")
    return relevel(recode(kept, "treatment", TREATMENT_RENAMES), "treatment", SIRNA_LEVELS)


def is_param(name: str):
    """Whether a row is of a modelled parameter; exports of the second kind put the unit after its name."""
    return (F.col("param") == name) | F.startswith("param", F.lit(f"{name} ("))


# The three comparisons of the silencing figure.
SIRNA_SETS = {"VEGF": "growth factor", "FGF2": "growth factor", "5% FBS": "FBS", "20% FBS": "FBS", "GDF-2": "GDF-2"}


def sirna_figure(readings: DataFrame, annotations: DataFrame, marks: DataFrame, param: str = "Z", freq: int = 64000,
                 first_bin: int = -2) -> DataFrame:
    """Growth factor, serum and GDF-2 comparisons at one frequency; series of one experiment only for GDF-2."""
    cells = materialise(sirna_cells(readings, annotations, marks, param=param, freq=freq), "cells")
    kept = replicated_horizon(cells.where(F.col("time_bin") >= first_bin))
    kept = relevel(kept, "gf", list(GF_LABELS), GF_LABELS).where(F.col("treatment") != "UT")
    shared = replicated_series(kept.where(F.col("gf") != "GDF-2"), ["gf", "conc"])
    both = shared.unionByName(kept.where(F.col("gf") == "GDF-2"))
    means = both.groupBy("param", "freq", "date", "conc", "gf", "treatment", "time_bin").agg(
        cell_mean().alias("value"))
    sets = F.create_map(*[F.lit(x) for pair in SIRNA_SETS.items() for x in pair])
    return mean_se(means.withColumn("panel", sets[F.col("gf")]), ["panel", "gf", "conc", "treatment", "time_bin"])


def sirna_frequencies(readings: DataFrame, annotations: DataFrame, marks: DataFrame, param: str = "Z",
                      freqs: Sequence[int] = (1000, 4000, 16000, 64000)) -> DataFrame:
    """The silencing comparison at several frequencies, release hour included."""
    cells = sirna_cells(readings, annotations, marks)
    means = materialise(replicated_series(cells, ["gf", "conc"]).groupBy(
        "param", "freq", "date", "conc", "gf", "treatment", "time_bin").agg(cell_mean().alias("value")), "means")
    kept = replicated_horizon(select_readings(means, freq=list(freqs), param=param))
    return mean_se(with_panels(kept, SIRNA_PANELS), ["panel", "freq", "conc", "treatment", "time_bin"])


def barrier_resistance(modelled: DataFrame, annotations: DataFrame, marks: DataFrame, param: str = "Rb") -> DataFrame:
    """Barrier resistance around release, silencing experiments, replicated series and hours only."""
    cells = sirna_cells(modelled, annotations, marks, MODEL_SERIES)
    means = materialise(replicated_series(cells, ["gf", "conc"]).groupBy(
        "date", "param", "gf", "conc", "treatment", "time_bin").agg(cell_mean().alias("value")), "means")
    kept = replicated_horizon(means).where(is_param(param))
    return mean_se(with_panels(kept, SIRNA_PANELS), ["panel", "treatment", "conc", "time_bin"])


def barrier_resistance_v1(modelled: DataFrame, readings: DataFrame, annotations: DataFrame, marks: DataFrame,
                          param: str = "Rb", carrier: str | None = SILENCER) -> DataFrame:
    """Barrier resistance around the first reading after release: single values for VEGF, experiment means
    for FGF2."""
    wide, cuts = plates(annotations, marks, carrier)
    dense = select_readings(wide, celldensity="5000")
    rows = rebase_to(modelled, starts_of(phase_rows(readings, cuts), dense))
    cells = materialise(annotate(hourly_cells(rows, MODEL_SERIES, spread=True), wide), "cells")
    binned = hour_bins(cells, ["date"], out="label", hour="hour", on_break="on_break")
    kept = binned.where("full and time_bin is not null and n > 0").where(is_param(param))
    kept = relevel(recode(kept, "treatment", TREATMENT_RENAMES), "treatment", SIRNA_LEVELS_NO_UT)
    panelled = with_panels(kept, SIRNA_PANELS)
    keys = ["panel", "treatment", "conc", "time_bin"]
    single = cells_mean_se(panelled.where(F.col("panel") == "VEGF"), keys)
    means = panelled.where(F.col("panel") == "FGF2").groupBy(*keys, "date").agg(cell_mean().alias("value"))
    return single.unionByName(mean_se(means, keys))


# --- modelled parameters ----------------------------------------------------------------------------

def modelled_wells(modelled: DataFrame, annotations: DataFrame, density: str | None = "5000",
                   serum: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(modelled values by time from their experiment's first one, the annotated wells they belong to)."""
    wide = materialise(wide_annotations(annotations, {"serum": "FBS"}), "wide")
    wells = select_readings(wide, celldensity=density, serum=serum)
    return rebase_to(modelled, starts_of(modelled, wells)), wells


def modelled_summary(modelled: DataFrame, annotations: DataFrame, max_time: float = 72,
                     exclude: Sequence[str] = (), experiments: DataFrame | None = None) -> DataFrame:
    """Modelled parameters of treated wells against controls, pairs formed inside each experiment."""
    modelled, annotations = of_class(experiments, modelled, annotations)
    rows, wells = modelled_wells(modelled, annotations)
    keys = ["date", "gf", "conc", "dose", "treatment", "param"]
    # Pairing sees all hours, the time limit comes after it: the flag keeps both in one pass.
    cells = hourly_cells(rows.withColumn("inside", F.col("time_h") <= max_time), [*MODEL_SERIES, "inside"])
    cells = materialise(annotate(cells, effective_doses(wells).select(*WELL, "gf", "conc", "dose", "treatment")), "cells")
    paired = exclude_dates(pairs(cells, ["date", "gf"]).where("inside"), exclude)
    binned = hour_bins(paired, ["gf", "pair_ind"], hour="hour", on_break="on_break").where("time_bin is not null")
    means = binned.groupBy("gf", "pair_ind", *[k for k in keys if k != "gf"], "time_bin").agg(
        cell_mean(na_rm=False).alias("value"))
    labelled = treat_labels(mark_untreated(means), LABEL_RENAMES_V1)
    return mean_se(labelled, ["gf", "pair_ind", "param", "dose", "treat2", "time_bin"])


def modelled_qc(modelled: DataFrame, annotations: DataFrame, column: str = "rmse", bins: int = 30,
                experiments: DataFrame | None = None) -> DataFrame:
    """Histogram of fit error or drift per pair, split by treatment."""
    modelled, annotations = of_class(experiments, modelled, annotations)
    wide = select_readings(wide_annotations(annotations, {"serum": "FBS"}), celldensity="5000")
    wells = effective_doses(wide).select(*WELL, "gf", "conc", "treatment")
    # A well's pairs are found from the wells that have values, one row each, before the values are joined.
    wells = materialise(keep_wells(wells, modelled.select(*WELL).distinct()), "wells")
    paired = annotate(modelled.select(*WELL, column), pairs(wells, ["date", "gf"]))
    return histogram(paired, column, ["gf", "pair_ind"], ["treatment"], bins)


# --- treatment and setup overviews ------------------------------------------------------------------

NORMALISATIONS = {"Raw": "raw", "Divide": "div_first", "Subtract": "sub_first"}


def treatment_overview(readings: DataFrame, annotations: DataFrame, marks: DataFrame, normalisation: str = "Raw",
                       max_time: float = 72, min_dose: float = 100, experiments: DataFrame | None = None) -> DataFrame:
    """Every experiment's pairs over time by dose class, raw or relative to each well's first value."""
    readings, annotations, marks = of_class(experiments, readings, annotations, marks)
    rows, wells = release_rows(readings, annotations, marks)
    wells = wells.where((F.col("dose") == 0) | (F.col("dose") > min_dose))
    wells = wells.withColumn("dose_bin", cut_breaks("dose", DOSE_BREAKS, include_lowest=True))
    rows = annotate(clip_time(rows, hi=max_time), wells)
    rows = normalise(rows, SERIES, NORMALISATIONS[normalisation])
    keys = ["date", "gf", "param", "conc", "treatment", "dose", "dose_bin", "freq", "time_h"]
    summary = materialise(mean_se(rows, keys), "overview")
    paired = pairs(summary, ["date", "gf", "param"])
    labels = group_label(paired, ["date", "gf", "param", "pair_ind"])
    labels = labels.select("date", "gf", "param", "pair_ind", "group_label")
    out = attach(paired, labels, ["date", "gf", "param", "pair_ind"])
    return out.withColumn("legend", legend_label("conc", "gf", "treatment"))


def setup_overview(readings: DataFrame, annotations: DataFrame, marks: DataFrame, serum: str = "FBS",
                   experiments: DataFrame | None = None) -> DataFrame:
    """Setup experiments after release by cell density, every growth factor, parameter and frequency. Readings whose times
    agree at six places are of one time."""
    readings, annotations, marks = of_class(experiments, readings, annotations, marks)
    rows, wells = release_rows(readings, annotations, marks, density=None, serum=serum)
    rows = annotate(rows, wells.select(*WELL, "gf", "conc", "celldensity")).withColumn("time_h", to_places("time_h"))
    return mean_se(rows, ["date", "gf", "param", "freq", "conc", "celldensity", "time_h"])


def setup_overview_modelled(modelled: DataFrame, annotations: DataFrame, serum: str = "FBS",
                            experiments: DataFrame | None = None) -> DataFrame:
    """Setup experiments by cell density from their first modelled value on, by times at six places."""
    modelled, annotations = of_class(experiments, modelled, annotations)
    rows, wells = modelled_wells(modelled, annotations, density=None, serum=serum)
    rows = annotate(rows, wells.select(*WELL, "gf", "conc", "celldensity")).withColumn("time_h", to_places("time_h"))
    return mean_se(rows, ["date", "gf", "param", "conc", "celldensity", "time_h"])


# --- hourly means and dose response -----------------------------------------------------------------

def hourly_well_means(values: DataFrame, annotations: DataFrame | None, series: Sequence[str] = MODEL_SERIES,
                      by: Sequence[str] = (), others: str | None = "others",
                      experiments: DataFrame | None = None) -> DataFrame:
    """Hourly mean of every well, hours counted over all rows (or per `by`), with the wells' annotations; layers that are
    not named come as a map in the column `others`. With `experiments`, hours too are counted over these only."""
    series = list(series)
    values, = of_class(experiments, values)
    cells = materialise(hourly_cells(values, series), "cells")
    binned = hour_bins(cells, by, hour="hour", on_break="on_break").where("time_bin is not null")
    means = binned.groupBy(*series, "time_bin").agg(cell_mean(na_rm=False).alias("value"))
    return means if annotations is None else annotate(means, widen_annotations(annotations, others=others))


def dose_response(hourly: DataFrame, gfs: Sequence[str], pools: Mapping[float, Sequence[float]],
                  extra_keys: Sequence[str] = (), serum: str | None = "FBS",
                  param_levels: Sequence[str] = ("Z1k", "Z2k", "Z4k", "Z8k", "Z16k", "Z32k", "Z64k")) -> DataFrame:
    """Mean, sd, n, se over experiments by hour, parameter and pooled concentration.

    `hourly` holds date, param, freq, time_bin, gf, log_conc, celldensity, serum, value. Where experiments
    differ in length all are cut to the shortest.
    """
    rows = hourly.where(F.col("gf").isin(list(gfs)))
    if serum is not None:
        rows = rows.where(F.col("serum") == serum).drop("serum")
    rows = rows.withColumn("conc", pool_values(unlog("log_conc"), pools))
    rows = rows.withColumn("parameter", F.concat("param", (F.col("freq") / 1000).cast("int").cast("string"), F.lit("k")))
    keys = ["time_bin", "parameter", "gf", "conc", *extra_keys]
    means = materialise(mean_by(rows, ["date", *keys], na_rm=False), "means")
    summary = summarise_experiments(common_length(means), keys)
    # Rows are complete before parameters are put in display order, where unlisted ones become missing.
    return relevel(complete_cases(summary), "parameter", param_levels)


def frequency_spectrum(readings: DataFrame, annotations: DataFrame, marks: DataFrame, how: str = "div_first",
                       panels: Mapping[str, Sequence[str]] | None = None, carrier: str | None = SILENCER) -> DataFrame:
    """All frequencies of silencing experiments side by side: wells relative to their first value after release, by
    treatment and dose."""
    rows, wells, heads = release_heads(readings, annotations, marks, SERIES, 1, carrier=carrier)
    cells = hourly_cells(rows, SERIES, spread=True)
    cells = materialise(annotate(cells, wells.select(*WELL, "gf", "conc", "treatment")), "cells")
    binned = hour_bins(cells, ["date"], hour="hour", on_break="on_break").where("time_bin is not null")
    based = attach(binned, baseline(heads, SERIES, how), SERIES)
    moved = scale_cells(based, "base") if how in DIVIDE else shift_cells(based, "base")
    return cells_mean_se(
        with_panels(moved, panels or SPECTRUM_PANELS), ["panel", "param", "freq", "treatment", "conc", "time_bin"])


def early_sirna(readings: DataFrame, annotations: DataFrame, marks: DataFrame, subtract_head: bool = True,
                panels: Mapping[str, Sequence[str]] | None = None, n: int = 3, carrier: str | None = SILENCER) -> DataFrame:
    """Silencing experiments after release, wells against the mean of their first three values (or raw)."""
    rows, wells, heads = release_heads(readings, annotations, marks, SERIES, n, known=True, carrier=carrier)
    cells = hourly_cells(rows, SERIES, spread=True)
    cells = materialise(annotate(cells, wells.select(*WELL, "gf", "conc", "treatment", "full")), "cells")
    binned = hour_bins(cells, ["date"], hour="hour", on_break="on_break")
    shown = replicated_horizon(binned.where("full and time_bin is not null and n > 0"))
    if subtract_head:
        # The cells kept of a series are its earliest, so its first kept values are those of its first values
        # that lie in kept cells.
        head = heads.withColumn("hour", F.floor("time_h"))
        head = head.withColumn("on_break", F.col("time_h") == F.col("hour"))
        inside = head.join(shown.select(*SERIES, "hour", "on_break"), [*SERIES, "hour", "on_break"], "left_semi")
        base = inside.groupBy(*SERIES).agg(F.avg("value").alias("base"))
        shown = shift_cells(attach(shown, base, SERIES), "base")
    return cells_mean_se(
        with_panels(shown, panels or EARLY_PANELS), ["panel", "param", "freq", "conc", "treatment", "time_bin"])
