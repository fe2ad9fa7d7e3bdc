"""Joins of readings with annotations and events, pairing, and range assignment.

No join here carries a broadcast hint: adaptive execution broadcasts a side when its measured size is
under the session's threshold, and otherwise splits skewed partitions of the larger side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.schema import LAYERS, WELL


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
           null_safe: bool = False) -> DataFrame:
    """Join the other columns of `right` to `left` on `keys`; with `null_safe`, NULL keys match each other.

    Use `null_safe` where `right` is an aggregate of `left` by the same keys. Groups with NULL keys then stay,
    and a hot key can be split: adaptive execution splits skewed partitions only where both sides of a join
    have an exchange of their own. Under plain equality an aggregate's exchange would serve the join too.
    """
    keys = list(keys)
    if not null_safe:
        return left.join(right, keys, how)
    other = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, cond, how).select(*left.columns, *[c for c in right.columns if c not in keys])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", null_safe: bool = True) -> DataFrame:
    """Join on all common columns; NULL equals NULL unless told otherwise."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no common columns")
    return attach(left, right, keys, how, null_safe)


def widen_annotations(annotations: DataFrame, layers: Mapping[str, str] | None = None,
                      defaults: Mapping[str, str] | None = None, names: str | None = None,
                      others: str | None = "others") -> DataFrame:
    """One row per (date, well), one column per named layer; `defaults` fill missing layers. The column `names`, if
    asked for, lists all layers that the well has, named in `layers` or not. The column `others` is a map from each layer
    that is not named to its value, the largest if there are several, as in named columns; no layer of the data is left
    out. `spread_layers` makes columns of it, None leaves it away. Spark drops it from plans that do not read it."""
    layers = dict(layers or LAYERS)
    wide = annotations.groupBy(*WELL).agg(*[
        F.max(F.when(F.col("layer") == layer, F.col("value"))).alias(name) for layer, name in layers.items()
    ], *([F.collect_set(F.when(F.col("value").isNotNull(), F.col("layer"))).alias(names)] if names else []),
       *([F.collect_set(F.when(~F.col("layer").isin(*layers) & F.col("value").isNotNull(),
                               F.struct("layer", "value"))).alias(others)] if others else []))
    if others:
        found = F.array_distinct(F.transform(others, lambda x: x["layer"]))
        wide = wide.withColumn(others, F.map_from_arrays(found, F.transform(found, lambda n: F.array_max(
            F.transform(F.filter(others, lambda x: x["layer"] == n), lambda x: x["value"])))))
    return wide.na.fill(dict(defaults)) if defaults else wide


def spread_layers(df: DataFrame, *names: str, others: str = "others") -> DataFrame:
    """Columns for the layers `names` out of the map `others`, missing where a well lacks the layer; `others` goes."""
    return df.select("*", *[F.col(others)[name].alias(name) for name in names]).drop(others)


def annotate(df: DataFrame, wide: DataFrame) -> DataFrame:
    """Inner join of readings or modelled values with wide annotations on (date, well).

    Rows without a date or well match nothing; they are dropped first, so that the join can be the kind whose
    hot keys are split also when `wide` comes straight from an aggregate.
    """
    return attach(df.na.drop("any", subset=list(WELL)), wide, WELL, null_safe=True)


def dates_with(annotations: DataFrame, value: str) -> DataFrame:
    """Dates of the experiments that carry an annotation value."""
    return annotations.where(F.col("value") == value).select("date").distinct()


def keep_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(dates.select("date"), "date", "left_semi")


def replicated_series(df: DataFrame, keys: Sequence[str] = ("gf", "conc"), over: str = "date",
                      min_n: int = 2) -> DataFrame:
    """Rows of the series seen in at least `min_n` different experiments."""
    seen = df.groupBy(*keys).agg(F.count_distinct(over).alias("_n")).where(F.col("_n") >= min_n)
    return df.join(seen.select(*keys), list(keys), "left_semi")


def pair_keys(df: DataFrame, groups: Sequence[str], conc: str = "conc", control: float | None = None) -> DataFrame:
    """(groups, pair_ind, conc) rows: for each induced concentration one row for itself and one for the control.

    The control is the smallest concentration of the group unless given. A group with one concentration
    makes a single pair of its own rows. Grows with the number of distinct concentrations only.
    """
    groups = list(groups)
    levels = df.where(F.col(conc).isNotNull()).select(*groups, conc).distinct()
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    first = F.min(conc).over(group) if control is None else F.lit(control).cast("double")
    levels = levels.select(*groups, F.col(conc).alias("pair_ind"), first.alias("_ctrl"),
                           F.count(F.lit(1)).over(group).alias("_n"))
    members = F.when(F.col("_n") == 1, F.array("pair_ind")).when(
        F.col("pair_ind") != F.col("_ctrl"), F.array("_ctrl", "pair_ind"))
    return levels.select(*groups, "pair_ind", F.explode(members).alias(conc))


def pairs(df: DataFrame, groups: Sequence[str], conc: str = "conc", control: float | None = None) -> DataFrame:
    """Rows of every control/induced pair, marked by `pair_ind`; control rows repeat once per pair.

    Meant for aggregated input, so that what repeats is small.
    """
    return df.join(pair_keys(df, groups, conc, control), [*groups, conc])


def dates_with_treated(df: DataFrame, keys: Sequence[str], dose: str = "dose", date: str = "date") -> DataFrame:
    """Keep, inside each key group, the dates that hold a treated row (dose above zero)."""
    keys = [*keys, date]
    treated = df.where(F.col(dose) > 0).select(*keys).distinct()
    return df.join(treated, keys, "left_semi")


def assign_ranges(df: DataFrame, ranges: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Attach the label of the range (lo, hi] a value lies in; `ranges` has `by`, lo, hi, label.

    The equality on `by` carries the join, the range is tested on its matches. Rows of `df` must be
    unique only in so far as ranges of one group do not overlap; rows outside every range are dropped.
    """
    hit = (F.col("lo") < F.col(value)) & (F.col(value) <= F.col("hi"))
    return df.join(ranges, list(by)).where(hit).drop("lo", "hi")


def overlap_join(df: DataFrame, ranges: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """Rows of `df` beside every range (lo, hi] of `ranges` that their value lies in; no key but the value is needed, and
    ranges may overlap.

    A range belongs to the level whose buckets, of `width` times a power of two, are at least as wide as it is, so it
    touches two buckets at most, and a value is looked up once per level that occurs. Bucket and level carry the join; the
    range is tested on what meets, and a value has one bucket per level, so no pair is lost or doubled. Ranges that reach
    beyond the values, infinite ones too, are cut to them first. Empty ranges and missing ends or values match nothing.
    """
    v = F.col(value)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    least, most = ends.select("lo").scalar(), ends.select("hi").scalar()
    lo, hi = F.greatest(F.col("lo"), least - F.lit(width)), F.least(F.col("hi"), most)
    cut = ranges.withColumns({"_lo": lo, "_hi": hi}).where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("_lo") < F.col("_hi")))
    level = F.greatest(F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / width)), F.lit(0))

    def size(n) -> Column:
        return F.lit(width) * F.pow(F.lit(2.0), n)

    levelled = cut.withColumn("_level", level)
    first, last = F.floor(F.col("_lo") / size(F.col("_level"))), F.floor(F.col("_hi") / size(F.col("_level")))
    dealt = levelled.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_lo", "_hi")
    levels = levelled.agg(F.collect_set("_level")).scalar()
    probes = df.where(v.isNotNull()).withColumn("_level", F.explode(levels))
    probes = probes.withColumn("_bucket", F.floor(v / size(F.col("_level"))))
    hit = (F.col("lo") < v) & (v <= F.col("hi"))
    return probes.join(dealt, ["_level", "_bucket"]).where(hit).drop("_level", "_bucket")
