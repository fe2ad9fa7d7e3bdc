"""Document fingerprints by winnowing, with built-in functions only (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import BLANK, Scratch, parts_for, text_of

GRAM = 3  #: tokens in a hashed gram
WINDOW = 6  #: grams of which one is kept at least
TOKEN = 12  #: words of more code points are taken code point by code point
BASE, PRIME = 48271, (1 << 31) - 1  #: of the polynomial hash of a gram
PLACES = 31  #: low bits of a fingerprint entry: the place, counted down, so that the least entry is the rightmost


def _once(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once per row, as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Entries (hash, place) that winnowing keeps of a text expression, in order of place, packed into longs.

    Tokens are lower-case words; a word of more than `TOKEN` code points, as in scripts without blanks, is taken as single
    code points, so tokens do not shift with what stands before them. Each token is hashed once; the hash of `gram`
    tokens is the polynomial in `BASE` modulo `PRIME` that a rolling update yields, here by Horner's rule over the token
    hashes, as built-in functions have no state that rolls without copying it. Of each `window`
    hashes in a row the least is kept, the rightmost among equals, with its place. So two texts that share
    `gram + window - 1` tokens in a row share an entry's hash. Fewer tokens than a gram make one gram, fewer
    grams than a window one window; no tokens, no entries.
    """
    blank = BLANK.replace("\\", "\\\\")
    tokens = f"regexp_extract_all(lower({text}), '((?<![^{blank}])[^{blank}]{{1,{TOKEN}}}(?![^{blank}])|[^{blank}])', 1)"
    tokens = f"transform({tokens}, x -> pmod(xxhash64(x), {PRIME}L))"
    rolled = "x"
    for k in range(1, gram):
        rolled = f"pmod({rolled} * {BASE}L + coalesce(get(t, i + {k}), 0L), {PRIME}L)"
    top = (1 << PLACES) - 1
    grams = (f"transform(slice(t, 1, greatest(size(t) - {gram - 1}, least(size(t), 1))), (x, i) -> "
             f"shiftleft({rolled}, {PLACES}) | ({top}L - i))")
    least = (f"case when size(g) = 0 then g else array_distinct(transform(sequence(1, greatest(size(g) - {window - 1}, 1)), "
             f"i -> array_min(slice(g, i, {window})))) end")
    return F.expr(_once(tokens, "t", _once(grams, "g", least)))


def shown(entries: str) -> Column:
    """A fingerprint as text: hash in hexadecimal and place of each entry."""
    return F.expr(f"array_join(transform({entries}, x -> concat(lower(hex(shiftright(x, {PLACES}))), ':', "
                  f"{(1 << PLACES) - 1}L - (x & {(1 << PLACES) - 1}L))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of the hashes of two fingerprints, 1 where both are empty."""
    def hashes(x):
        return f"array_distinct(transform({x}, x -> shiftright(x, {PLACES})))"
    common = "size(array_intersect(p, q))"
    both = f"size(p) + size(q) - {common}"
    return F.expr(_once(hashes(a), "p", _once(hashes(b), "q", f"case when size(p) + size(q) = 0 then 1.0D else "
                                              f"cast({common} as double) / ({both}) end")))


def in_order(keys: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """For each row `(a, h, n)`, in descending order of (a, h), the row before (`prev_*`, the last for the first).

    Ranges by sampled bounds, a window inside each, and one row per range for the seams between them: the only
    unpartitioned window sees as many rows as there are ranges.
    """
    scratch = Scratch(keys.sparkSession, "order")
    keys = scratch.keep(keys, "keys")
    parts = parts_for(keys.count(), rows_per_range)
    ranged = scratch.keep(keys.repartitionByRange(parts, F.desc("a"), F.desc("h"))
                          .withColumn("p", F.spark_partition_id()), "ranges")
    row = F.struct("a", "h", "n")
    seams = ranged.groupBy("p").agg(F.min(row).alias("last"))
    every = Window.orderBy("p")
    seams = scratch.keep(seams.select("p", F.coalesce(
        F.lag("last").over(every),
        F.last("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("seam")), "seams")
    inside = F.lag(row).over(Window.partitionBy("p").orderBy(F.desc("a"), F.desc("h")))
    return (ranged.withColumn("prev", inside).join(F.broadcast(seams), "p")  # a row per range
            .withColumn("prev", F.coalesce("prev", "seam"))
            .select("a", "h", F.col("prev.a").alias("prev_a"), F.col("prev.h").alias("prev_h"),
                    F.col("prev.n").alias("prev_n")))


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM,
                      window: int = WINDOW) -> DataFrame:
    """`id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` per row of `docs`.

    The edited text has its last third (in code points, rounded down) replaced by as many first code points of the next
    document, by descending id, the first after the last; a null id (and the least of all longs, taken for it) comes last; rows that differ in text only are
    ordered by a hash of it, and rows alike in id and text count as one there and repeat in the result. Null text
    is empty. A single document is its own next one. An empty table gives no rows.

    Texts go through one shuffle that both uses of it share; from each document only the third that its neighbour needs,
    and the hashes of its fingerprint, are sent on.
    """
    a = F.coalesce(F.col(id).cast("long"), F.lit(-1 << 63))
    plain = docs.select(F.col(id).alias("id"), a.alias("a"), text_of(text).alias("text")).withColumn(
        "h", F.xxhash64("text", F.col("id").isNull()))
    keys = plain.select("a", "h", F.char_length("text").cast("long").alias("n")).distinct()
    order = Scratch(docs.sparkSession, "neighbours").keep(in_order(keys), "order")
    # alike for both uses, so that they share one shuffle; fingerprints are made after it, which moves less
    base = plain.select("a", "h", "text").groupBy("a", "h").agg(
        F.any_value("text").alias("text"), F.count("*").alias("m")).filter("m > 0")
    hashes = F.expr(f"transform(fp, x -> cast(shiftright(x, {PLACES}) - {1 << 31}L as int))")  # half the bytes of entries
    heads = (base.join(order, ["a", "h"]).withColumn("fp", fingerprint("text", gram, window))
             .select(F.col("prev_a").alias("a"), F.col("prev_h").alias("h"), hashes.alias("next_hashes"),
                     F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head")))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    out = base.join(heads, ["a", "h"]).select("a", "text", n.cast("long").alias("n_chars"), edited.alias("edited"),
                                              "next_hashes", "m")
    out = out.select("a", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                     fingerprint("text", gram, window).alias("fp"), fingerprint("edited", gram, window).alias("edited_fp"),
                     F.expr(f"transform(next_hashes, x -> shiftleft(x + {1 << 31}L, {PLACES}))").alias("next_fp"), "m")
    out = out.select(F.nullif(F.col("a"), F.lit(-1 << 63)).alias(id), "n_chars", "edited_sha256",
                     shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
                     likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "m")
    return out.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")
