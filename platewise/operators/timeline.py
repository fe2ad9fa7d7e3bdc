"""Aligning time, hour bins, phases and horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.joins import attach

# Phase names by number of marks.
PHASES_TWO_MARKS = ("Seed", "Starv", "Release")
PHASES_THREE_MARKS = ("Seed", "Starv", "Preinc", "Release")


# --- origin of time -------------------------------------------------------------------------------

def start_times(df: DataFrame, by: Sequence[str] = ("date",), time: str = "time_h") -> DataFrame:
    return df.groupBy(*by).agg(F.min(time).alias("start_h"))


def rebase_to_start(df: DataFrame, by: Sequence[str] = ("date",), time: str = "time_h",
                    out: str | None = None) -> DataFrame:
    """Time counted from the group's first reading."""
    joined = attach(df, start_times(df, by, time), by, null_safe=True)
    return joined.withColumn(out or time, F.col(time) - F.col("start_h")).drop("start_h")


def release_time(marks: DataFrame, how: str = "max", label_like: str | None = None) -> DataFrame:
    """(date, mark_h): the last (or first) mark of each date, or of those whose label matches a pattern."""
    if label_like is not None:
        marks = marks.where(F.col("label").rlike(label_like))
    agg = F.max if how == "max" else F.min
    return marks.groupBy("date").agg(agg("time_h").alias("mark_h"))


def rebase_to_mark(df: DataFrame, release: DataFrame, time: str = "time_h", out: str | None = None,
                   how: str = "left") -> DataFrame:
    """Time counted from the date's release; negative before it. A left join leaves NULL where no mark exists."""
    joined = attach(df, release.select("date", "mark_h"), ["date"], how, null_safe=True)
    return joined.withColumn(out or time, F.col(time) - F.col("mark_h")).drop("mark_h")


def rebase_to(df: DataFrame, starts: DataFrame, by: Sequence[str] = ("date",), time: str = "time_h") -> DataFrame:
    """Time counted from given starts (by, start_h); groups without one are dropped."""
    return attach(df, starts, by, null_safe=True).withColumn(time, F.col(time) - F.col("start_h")).drop("start_h")


def clip_time(df: DataFrame, lo: float | None = None, hi: float | None = None, time: str = "time_h") -> DataFrame:
    if lo is not None:
        df = df.where(F.col(time) >= lo)
    if hi is not None:
        df = df.where(F.col(time) <= hi)
    return df


# --- hour bins --------------------------------------------------------------------------------------
# Break points are the whole hours present in the group; a bin reaches from above one break up to and
# including the next, the lowest break belongs to the first bin, and what lies after the last break has none.

def hour_breaks(df: DataFrame, by: Sequence[str], hour: str) -> DataFrame:
    """(by, hour, _rank, _next): the group's distinct hours, numbered, with the hour that follows.

    The window runs over distinct hours, whose number per group is the length of the recording.
    """
    hours = df.where(F.col(hour).isNotNull()).select(*by, hour).distinct()
    w = Window.partitionBy(*by).orderBy(hour) if by else Window.partitionBy(F.lit(1)).orderBy(hour)
    return hours.select(*by, hour, F.row_number().over(w).alias("_rank"), F.lead(hour).over(w).alias("_next"))


def bin_of(hour: Column, on_break: Column, rank: Column, following: Column, out: str) -> Column:
    """Bin of a time given its hour, whether it is a whole hour, and the hour's place among the breaks."""
    lowest = rank == 1
    if out == "ordinal":
        inside = F.when(following.isNotNull(), rank)
        on_edge = F.when(lowest, inside).otherwise(rank - 1)
    elif out == "label":
        inside = following
        on_edge = F.when(lowest, following).otherwise(hour)
    else:
        raise ValueError("out is 'ordinal' or 'label'")
    return F.when(on_break, on_edge).otherwise(inside).cast("int")


def hour_bins(df: DataFrame, by: Sequence[str] = ("date",), time: str = "time_h", out: str = "ordinal",
              name: str = "time_bin", hour: str | None = None, on_break: str | None = None,
              windowed: bool = False, breaks: DataFrame | None = None) -> DataFrame:
    """Add the hour bin of each row: its ordinal among the group's bins, or its upper break.

    `hour` and `on_break` name columns that already hold the whole hour and the whole-hour test, as the
    hourly cells do; otherwise both come from `time`. NULL times give NULL bins.

    The breaks are found from the distinct hours and joined back. `windowed` finds them by a window over the
    rows instead, which saves reading the input twice; it is for cells grouped by whole series, where a
    group is never longer than its recording has hours. `breaks` gives them, as `hour_breaks` makes them,
    when they belong to a larger set of rows than is binned.
    """
    by = list(by)
    work = df
    if hour is None:
        hour, on_break = "_hour", "_on_break"
        work = work.withColumn(hour, F.floor(time)).withColumn(on_break, F.col(time) == F.col("_hour"))
    if windowed:
        joined = with_next_hour(work, by, hour)
    else:
        found = hour_breaks(work, by, hour) if breaks is None else breaks
        joined = attach(work, found, [*by, hour], "left", null_safe=True)
    binned = joined.withColumn(
        name, bin_of(F.col(hour), F.col(on_break), F.col("_rank"), F.col("_next"), out))
    return binned.select(*df.columns, name)


def with_next_hour(df: DataFrame, by: Sequence[str], hour: str) -> DataFrame:
    """Adds `_rank`, the number of the row's hour among the group's distinct hours, and `_next`, the hour that follows.

    Rows of one hour are a run. Going down in time, the row before a run's first one lies in the next hour; it is noted
    there and carried along the run, so every row is looked at once however long the recording is.
    """
    w = Window.partitionBy(*by)
    down = w.orderBy(F.col(hour).desc_nulls_last())
    noted = df.withColumn("_before", F.lag(hour).over(down))
    opens = F.when(F.col("_before").isNull() | (F.col("_before") > F.col(hour)), F.struct("_before"))
    carried = F.last(opens, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    there = F.col(hour).isNotNull()
    return noted.withColumn("_next", F.when(there, carried["_before"])).withColumn(
        "_rank", F.when(there, F.dense_rank().over(w.orderBy(F.col(hour).asc_nulls_last())))).drop("_before")


def hourly_cells(df: DataFrame, keys: Sequence[str], time: str = "time_h", value: str = "value",
                 spread: bool = False) -> DataFrame:
    """Sum and counts per key, whole hour and whole-hour test; `spread` adds the squared deviations (m2).

    Any hour bin is a union of such cells, so means and standard errors over bins can be finished from them;
    the readings are reduced to hours before the first shuffle and before any join that follows.
    """
    hour = F.floor(time)
    more = [(F.var_pop(value) * F.count(value)).alias("m2")] if spread else []
    return df.groupBy(*keys, hour.alias("hour"), (F.col(time) == hour).alias("on_break")).agg(
        F.sum(value).alias("total"), F.count(value).alias("n"), F.count(F.lit(1)).alias("n_rows"), *more)


def align_right(df: DataFrame, by: Sequence[str] = ("date",), name: str = "time_bin") -> DataFrame:
    """Bins counted back from the group's last one, which becomes 0."""
    last = df.groupBy(*by).agg(F.max(name).alias("_last"))
    return attach(df, last, by, null_safe=True).withColumn(name, F.col(name) - F.col("_last")).drop("_last")


# --- phases -----------------------------------------------------------------------------------------

def marks_wide(marks: DataFrame) -> DataFrame:
    """(date, n_marks, mark_1..mark_3), marks in order of time; n_marks is 4 for any larger number."""
    w = Window.partitionBy("date").orderBy("time_h")
    first = marks.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= 4)
    return first.groupBy("date").agg(
        F.max("_i").alias("n_marks"),
        *[F.max(F.when(F.col("_i") == i, F.col("time_h"))).alias(f"mark_{i}") for i in (1, 2, 3)])


def refused_dates(marks: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(date, n_marks, reason): the dates whose marks do not part a recording into phases, with the reason.

    Two or three marks are needed, each with a time of its own above zero. With `dates` (a table of all dates), those
    without a mark are refused as well. One row per date; everything is a count, so many marks do no harm.
    """
    t = F.col("time_h")
    counted = marks.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_marks"), F.count(t).alias("_timed"), F.count_distinct(t).alias("_own"), F.min(t).alias("_lo"))
    if dates is not None:
        counted = attach(dates.select("date").distinct(), counted, ["date"], "left", null_safe=True).na.fill(
            0, ["n_marks", "_timed", "_own"])
    n = F.col("n_marks")
    reason = (F.when(n == 0, "no marks").when(n < 2, "fewer than two marks").when(n > 3, "more than three marks")
              .when(F.col("_timed") < n, "a mark without a time").when(F.col("_own") < n, "two marks at one time")
              .when(F.col("_lo") <= 0, "a mark at or before the start"))
    return counted.select("date", "n_marks", reason.alias("reason")).where("reason is not null")


def sound_marks(marks: DataFrame) -> DataFrame:
    """The marks of all dates that `refused_dates` does not name."""
    bad = refused_dates(marks).select(F.col("date").alias("_date"))
    return marks.join(bad, F.col("date").eqNullSafe(F.col("_date")), "left_anti")


def segment_by_marks(df: DataFrame, marks: DataFrame, time: str = "time_h", name: str = "mark",
                     on_invalid: str = "error") -> DataFrame:
    """Phase of each row from the marks table; see `segment_by_cuts`."""
    return segment_by_cuts(df, marks_wide(marks), time, name, on_invalid)


def segment_by_cuts(df: DataFrame, cuts: DataFrame, time: str = "time_h", name: str = "mark",
                    on_invalid: str = "error") -> DataFrame:
    """Phase of each row. Two marks part Seed, Starv, Release; three part Seed, Starv, Preinc, Release.

    `cuts` is what `marks_wide` gives. Phases are open to the left, so time 0 has none. Dates with any other number of
    marks raise an error, get NULL with on_invalid='null', or are left out with on_invalid='drop'; `refused_dates` names
    them. Each date contributes one row, so the join adds no rows.
    """
    t = F.col(time)
    two, three = PHASES_TWO_MARKS, PHASES_THREE_MARKS
    by_two = F.when(t <= F.col("mark_1"), two[0]).when(t <= F.col("mark_2"), two[1]).otherwise(two[2])
    by_three = (
        F.when(t <= F.col("mark_1"), three[0]).when(t <= F.col("mark_2"), three[1])
        .when(t <= F.col("mark_3"), three[2]).otherwise(three[3])
    )
    n = F.col("n_marks")
    if on_invalid == "drop":
        cuts = cuts.where(n.isin(2, 3))
    bad = F.lit(None).cast("string") if on_invalid != "error" else F.raise_error(
        F.concat(F.lit("two or three marks are needed, date "), F.col("date"))).cast("string")
    phase = F.when(n == 2, F.when(t > 0, by_two)).when(n == 3, F.when(t > 0, by_three)).otherwise(bad)
    joined = attach(df, cuts, ["date"], "inner" if on_invalid == "drop" else "left", null_safe=True)
    return joined.withColumn(name, phase).drop("n_marks", "mark_1", "mark_2", "mark_3")


def mark_ranges(marks: DataFrame) -> DataFrame:
    """(date, lo, hi, label) of every phase, for range joins; the last one is open to the right."""
    inf = F.lit(float("inf"))
    two = F.array(
        F.struct(F.lit(0.0).alias("lo"), F.col("mark_1").alias("hi"), F.lit(PHASES_TWO_MARKS[0]).alias("label")),
        F.struct(F.col("mark_1").alias("lo"), F.col("mark_2").alias("hi"), F.lit(PHASES_TWO_MARKS[1]).alias("label")),
        F.struct(F.col("mark_2").alias("lo"), inf.alias("hi"), F.lit(PHASES_TWO_MARKS[2]).alias("label")))
    three = F.array(
        F.struct(F.lit(0.0).alias("lo"), F.col("mark_1").alias("hi"), F.lit(PHASES_THREE_MARKS[0]).alias("label")),
        F.struct(F.col("mark_1").alias("lo"), F.col("mark_2").alias("hi"), F.lit(PHASES_THREE_MARKS[1]).alias("label")),
        F.struct(F.col("mark_2").alias("lo"), F.col("mark_3").alias("hi"), F.lit(PHASES_THREE_MARKS[2]).alias("label")),
        F.struct(F.col("mark_3").alias("lo"), inf.alias("hi"), F.lit(PHASES_THREE_MARKS[3]).alias("label")))
    spans = F.when(F.col("n_marks") == 2, two).when(F.col("n_marks") == 3, three)
    return marks_wide(marks).select("date", F.explode(spans).alias("s")).select("date", "s.lo", "s.hi", "s.label")


def phase_durations(marks: DataFrame) -> DataFrame:
    """(date, preinc, starv): hours from the second and from the first mark to the third."""
    return marks_wide(marks).select(
        "date", (F.col("mark_3") - F.col("mark_2")).alias("preinc"), (F.col("mark_3") - F.col("mark_1")).alias("starv"))


def phase_duration_summary(marks: DataFrame, known_only: bool = False) -> DataFrame:
    """(variable, value): mean and standard error of both durations over dates, one row each.

    A date without a third mark makes the figures NULL, since its durations are unknown; with `known_only` the figures
    are those of the dates whose durations are known.
    """
    d = phase_durations(marks)
    cols = []
    for c in ("preinc", "starv"):
        whole = F.lit(True) if known_only else F.count(F.lit(1)) == F.count(c)
        cols.append(F.when(whole, F.avg(c)).alias(f"{c}_mean"))
        cols.append(F.when(whole, F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se"))
    return d.agg(*cols).unpivot([], [f"{c}_{s}" for c in ("preinc", "starv") for s in ("mean", "se")],
                                "variable", "value")


# --- horizons ---------------------------------------------------------------------------------------

def replicated_horizon(df: DataFrame, name: str = "time_bin", min_n: int = 2, over: str = "date",
                       counted: DataFrame | None = None) -> DataFrame:
    """Rows up to the last bin that at least `min_n` experiments share; bins before it all stay."""
    source = df if counted is None else counted
    cut = (
        source.groupBy(name).agg(F.count_distinct(over).alias("_n"))
        .where(F.col("_n") >= min_n).agg(F.max(name).alias("cut"))
    )
    return df.where(F.col(name) <= cut.scalar())


def common_length(df: DataFrame, by: str = "date", time: str = "time_bin") -> DataFrame:
    """Rows with time up to the smallest number of distinct times any experiment has."""
    cut = df.groupBy(by).agg(F.count_distinct(time).alias("_n")).agg(F.min("_n").alias("cut"))
    return df.where(F.col(time) <= cut.scalar())
