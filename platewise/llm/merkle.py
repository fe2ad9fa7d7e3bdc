"""Merkle manifest of a dataset by nested-interval labels, and proofs for every row (operator 13).

Every row is a leaf. The leaves of a source are ranked by id; a node carries the interval [lo, hi) of leaf ranks that it
covers, so an ancestor of a node is one whose interval contains the node's. Per source the tree has a fan of three, and the
roots of the sources, in order, are the leaves of one more such tree.

* *Up.* Level by level, nodes are grouped by bucket, the number of the interval of that level's width that their `lo` lies
  in: at most three meet in one, whatever the source's size, so a hot source is many small groups.
* *Down.* Level by level, nodes are joined to the nodes of the level above by (tree, bucket) and containment. A parent holds
  its children's intervals; those left of the node's own interval and those right of it are its siblings. A path is the list
  of (text before, text after) from a node up to the root, so it hashes any leaf up to a root and spells the proof.

A tree's depth grows with the logarithm of its leaves, and so does a path, the one thing here that is longer than a digest.
Nothing is collected but the depth. Ranks come from a sort by ranges with counts per (part, source), not from a window
over a source. All of it is built-in functions.

Nulls: a null value is hashed as `-`; a null source is a source, first in order; a null id ranks first and is never
tampered with. Repeated rows are leaves of their own, side by side. An empty table gives an empty result; a source with one
row is its own root. Texts of any length are hashed whole. Columns beyond those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, parts_for

FAN = 3
KIDS = "array<struct<lo:bigint,hi:bigint,digest:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-`, or UTF-8 length, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """SHA-256, in lower-case hexadecimal, of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(doc_id, source, leaf, tampered): digest of each row, and of the row with line ends taken out of the text where
    two divides the checksum of the id."""
    id, source, *_, text = fields
    even = F.crc32(F.col(id).cast("string").cast("binary")) % 2 == 0
    head = [field(F.col(f)) for f in fields[:-1]]
    cut = F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    return docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"),
                       digest(*head, field(F.col(text))).alias("leaf"), digest(*head, field(cut)).alias("tampered"))


def ranked(df: DataFrame, by: str, order: list[str], scratch: Scratch, name: str, per_part: int = 250_000) -> DataFrame:
    """`df` with `rank`, the place of each row in its group by `order`, and `n`, the group's size.

    Rows are sorted by ranges of (by, order); a row's rank is its place inside its part, after the group's rows in the
    parts before. Only rows that are alike in all of that must lie in one part.
    """
    keys = [F.col(by).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    parts = parts_for(df.count(), per_part, 8)
    placed = scratch.keep(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), name)
    sizes = placed.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_size"))
    whole = Window.partitionBy("_by")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.keep(sizes.select("_by", "_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
                                       F.sum("_size").over(whole).alias("n")), f"{name}-starts")
    here = Window.partitionBy("_part", by).orderBy(*keys[1:])
    local = placed.withColumn("_local", F.row_number().over(here) - 1)
    same = (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by"))
    return local.join(starts, same).withColumn("rank", F.col("_start") + F.col("_local")).drop(
        "_part", "_p", "_by", "_start", "_local")


def bucket(rank: str, level: int) -> Column:
    """Which interval of the level's width a leaf rank lies in."""
    return F.expr(f"{rank} div {FAN ** level}")


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels of the trees over `nodes` (g, n, lo, hi, digest), leaves first: nodes of level l with `kids`, their
    children's intervals and digests. A group's last node covers all its n leaves, and enters no further level."""
    deepest = nodes.agg(F.max("n")).first()[0] or 1
    levels = [nodes.withColumn("kids", F.lit(None).cast(KIDS))]
    while FAN ** (len(levels) - 1) < deepest:
        level = len(levels)
        below = levels[-1].filter(F.col("hi") - F.col("lo") < F.col("n"))
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        up = below.groupBy("g", "n", bucket("lo", level).alias("_b")).agg(kids.alias("kids")).select(
            "g", "n", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform("kids", lambda k: k["digest"]), "")).alias("digest"), "kids")
        levels.append(scratch.keep(up, f"{name}-{level}"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(g, level, digest) of the node of each tree that covers all leaves."""
    found = [x.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select(
        "g", F.lit(i).alias("level"), "digest") for i, x in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


PATH = "array<struct<before:string,after:string>>"


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """`levels[0]`, whatever columns it has, with `path`, from a leaf upward; `tops` has (g, level, path): the level of each tree's root and the path
    that goes on above it."""
    above = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        ends = nodes.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).join(
            tops.filter(F.col("level") == level).select("g", "path"), "g")
        if above is None:
            above = ends
            continue
        parents = above.select(F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                               F.col("kids").alias("_kids"), F.col("path").alias("_path"))
        inside = ((F.col("g") == F.col("_g")) & (bucket("lo", level + 1) == bucket("_lo", level + 1))
                  & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        left = F.filter("_kids", lambda k: k["hi"] <= F.col("lo"))
        right = F.filter("_kids", lambda k: k["lo"] >= F.col("hi"))
        step = F.struct(F.array_join(F.transform(left, lambda k: k["digest"]), "").alias("before"),
                        F.array_join(F.transform(right, lambda k: k["digest"]), "").alias("after"))
        below = nodes.filter(F.col("hi") - F.col("lo") < F.col("n")).join(parents, inside)
        below = below.withColumn("path", F.concat(F.array(step), "_path")).drop("_g", "_lo", "_hi", "_kids", "_path")
        above = below.unionByName(ends)
    return above


def fold(start: str, path: str) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, F.col(start), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, leaf_rank, siblings) per row of `docs`.

    `proof_sha256` hashes the siblings' digests from the leaf's level up to the root, left to right; `folded_root` is what
    the leaf as tampered with leads to with the siblings of the untouched tree; `verified` says whether it is `root`.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    base = scratch.keep(ranked(leaves(docs, fields), "source", ["doc_id", "leaf", "tampered"], scratch, "placed"), "ranked")
    # sources in order are numbered by the same means
    sources = base.groupBy("source").agg(F.max("n").alias("size")).withColumn("all", F.lit(0))
    numbers = scratch.keep(ranked(sources, "all", ["source"], scratch, "sources").select(
        F.col("source").alias("_source"), F.col("rank").alias("g"), F.col("n").alias("sources")), "numbers")
    rows = scratch.keep(base.join(numbers, base["source"].eqNullSafe(numbers["_source"])).select(
        "g", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), "tampered",
        "doc_id", "source"), "leaves")
    levels = climb(rows.select("g", "n", "lo", "hi", "digest"), scratch, "level")
    subroots = scratch.keep(roots(levels), "subroots")
    # the tree of the sources: one group
    upper = scratch.keep(subroots.join(numbers, "g").select(
        F.lit(0).alias("g"), F.col("sources").alias("n"), F.col("g").alias("lo"), (F.col("g") + 1).alias("hi"), "digest"), "upper")
    upper_levels = climb(upper, scratch, "upper-level")
    summit = scratch.keep(roots(upper_levels), "root")
    ends = descend(upper_levels, summit.select("g", "level", F.array().cast(PATH).alias("path")))
    tops = scratch.keep(ends.select(F.col("lo").alias("g"), "path").join(subroots, "g").select(
        "g", "level", "path", F.col("digest").alias("subroot")), "tops")
    paths = descend([rows.withColumn("kids", F.lit(None).cast(KIDS)), *levels[1:]], tops.select("g", "level", "path"))
    root = summit.select(F.col("digest").alias("root"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = paths.join(tops.select("g", "subroot"), "g").withColumn("root", root.scalar())
    out = out.withColumn("folded_root", fold("tampered", "path")).withColumn("_proof", proof)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2("_proof", 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source",
                      F.col("lo").alias("leaf_rank"), F.expr("length(_proof) div 64").alias("siblings"))
