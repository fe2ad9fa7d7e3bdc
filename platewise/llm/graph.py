"""Connected components in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, root) for each node that has an edge (a, b), but for the roots themselves: the least node that it reaches.

    Alternating large and small stars: first every node hands its greater neighbours to the least node around it, then
    every node does so with its lesser ones and itself. Rows never grow, and a path of any order folds in a number of
    rounds that grows with the logarithm of its length. A node's neighbours are never gathered: its least neighbour is an
    aggregate, joined back.
    """
    up, low = F.greatest("a", "b").alias("c"), F.least("a", "b").alias("up")
    held = scratch.keep(edges.filter("a != b").select(up, low).distinct(), f"{name}-0")
    mark, step = _mark(held), 0
    while mark[0]:
        step += 1
        both = held.unionByName(held.select(F.col("up").alias("c"), F.col("c").alias("up")))
        least = both.groupBy("c").agg(F.min(F.least("c", "up")).alias("m"))
        large = scratch.keep(both.join(least, "c").filter("up > c").select(F.col("up").alias("c"), F.col("m").alias("up"))
                             .distinct(), f"{name}-{step}-large")
        near = large.groupBy("c").agg(F.min("up").alias("m"))
        small = large.join(near, "c").filter("up != m").select(F.col("up").alias("c"), F.col("m").alias("up")).unionByName(
            near.withColumnRenamed("m", "up"))
        held = scratch.keep(small.distinct(), f"{name}-{step}")
        before, mark = mark, _mark(held)
        if mark == before:
            break
    return held.withColumnRenamed("up", "root")


def _mark(edges: DataFrame) -> tuple:
    """What tells one table of edges from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("c", "up")), F.bit_xor(F.xxhash64("up", "c"))).first())


def merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, root) after more links (a, b) between nodes: components of components."""
    if roots is None:
        return components(links, scratch, name)
    over = (links.join(roots.withColumnsRenamed({"c": "a", "root": "a2"}), "a", "left")
            .join(roots.withColumnsRenamed({"c": "b", "root": "b2"}), "b", "left")
            .select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")))
    top = components(over, scratch, name).select(F.col("c").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("c", F.coalesce("top", "root").alias("root"))
    # nodes that had no link before, and roots that have one now
    new = top.select(F.col("root").alias("c"), F.col("top").alias("root"))
    return scratch.keep(moved.unionByName(new), f"{name}-merged")
