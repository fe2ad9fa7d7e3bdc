"""Experiment classes from the annotation layers each experiment has."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.joins import attach, widen_annotations


def layer_presence(annotations: DataFrame, layers: Sequence[str] | None = None, max_layers: int = 1000) -> DataFrame:
    """Date by layer table of 0 and 1. Without `layers` the names are looked up, which runs a small job."""
    if layers is None:
        found = annotations.select("layer").distinct().orderBy("layer").limit(max_layers + 1).collect()
        if len(found) > max_layers:
            raise ValueError(f"more than {max_layers} layer names")
        layers = [r[0] for r in found]
    return annotations.groupBy("date").agg(
        *[F.max(F.when(F.col("layer") == x, 1).otherwise(0)).alias(x) for x in layers])


def dates_of_class(annotations: DataFrame, having: Sequence[str] = (), lacking: Sequence[str] = ()) -> DataFrame:
    """(date): experiments that have all of the layers `having` and none of `lacking`, as a layer with a value in any well.

    One aggregate with a row per experiment. A class by what its experiments are made of, whichever others there are;
    the figure tables take it as `experiments`.
    """
    there = F.collect_set(F.when(F.col("value").isNotNull() & F.col("layer").isin(*having, *lacking), F.col("layer")))
    per_date = annotations.groupBy("date").agg(there.alias("_layers"))
    wanted = [F.array_contains("_layers", x) for x in having] + [~F.array_contains("_layers", x) for x in lacking]
    return per_date.where(reduce(lambda a, b: a & b, wanted, F.lit(True))).select("date")


def layer_signatures(annotations: DataFrame) -> DataFrame:
    """(date, signature): the sorted layer names of each experiment, joined by commas."""
    per_date = annotations.select("date", "layer").distinct()
    return per_date.groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("signature"))


def classify_experiments(annotations: DataFrame, k: int = 3, max_signatures: int = 500) -> DataFrame:
    """(date, class): complete-linkage classes of experiments by the layers they have, numbered by date order.

    Experiments with equal layers are one point, so only distinct layer sets are compared: their number is
    checked against `max_signatures` before they reach the driver, and experiments never do.
    """
    per_date = layer_signatures(annotations)
    rows = per_date.groupBy("signature").agg(F.min("date").alias("first")).orderBy("first").limit(
        max_signatures + 1).collect()
    if len(rows) > max_signatures:
        raise ValueError(f"more than {max_signatures} distinct layer sets")
    classes = _merge([r["signature"] for r in rows], k)
    mapping = annotations.sparkSession.createDataFrame(
        [(r["signature"], c) for r, c in zip(rows, classes)], "signature string, class int")
    return per_date.join(F.broadcast(mapping), "signature").select("date", "class")


def wide_by_class(annotations: DataFrame, k: int = 3, max_signatures: int = 500, others: str | None = "others") -> DataFrame:
    """Wide annotations with the class of their experiment beside them, a missing serum filled with FBS; layers that are
    not named are in the map `others`.

    The classes are the setup, treatment and silencing tables; one table with a key column holds them all.
    """
    wide = widen_annotations(annotations, defaults={"serum": "FBS"}, others=others)
    return attach(wide, classify_experiments(annotations, k, max_signatures), ["date"])


def _merge(signatures: Sequence[str], k: int) -> list[int]:
    """Class of each layer set. Sets come in order of their first date, which also settles ties."""
    sets = [frozenset(s.split(",")) for s in signatures]
    groups = [[i] for i in range(len(sets))]

    def apart(a: list[int], b: list[int]) -> float:
        return max(len(sets[i] ^ sets[j]) ** 0.5 for i in a for j in b)

    while len(groups) > k:
        _, a, b = min((apart(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
        groups.sort()
    return [1 + next(g for g, members in enumerate(groups) if i in members) for i in range(len(sets))]
