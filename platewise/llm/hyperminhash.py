"""Near duplicates by HyperMinHash sketches of 2-word shingles, links confirmed on the full sets (operator 11).

A sketch has 200 registers: in each of 25 rounds the shingles are hashed anew and dealt to 8 buckets, and a bucket keeps of
its least hash only the number of leading zeros and the ten bits after the first one: 16 bits, whatever the size of the set.
Two registers agree as often as the sets are alike, and by chance now and then, which the estimate is corrected for.

1. *Classes.* Texts with the same set are one class; all further work is on classes.
2. *Bands.* Five registers in a row make a band, 40 in all. Two sets that are 0.8 alike agree in a band with probability
   0.33, so they miss all with probability 1e-7. Classes that agree in a band share a bucket; bands in which a set has no
   shingle at all are not used.
3. *Rounds.* Each bucket has a pivot, another one each round. A class is held against the one pivot, of another component,
   that it shares most buckets with: by the estimate first, then on the full sets. Links join components. So a group of
   thousands of near copies takes as many comparisons as it has members, times a few.
4. *Rest.* Buckets that hold several components still are gone through in blocks, with their texts; pairs of different
   components that the estimate does not rule out are held against the full sets there, and only links come out. The
   estimate rules out what lies 4.5 standard deviations below the threshold.

Classes and shingles are named by 64-bit hashes. Handling: a text without words (null, empty, blanks) has no shingles, no
links, and its own id; one of a single word has that word as its set. Rows with equal sets are linked, so repeated rows
are; ids may repeat or be null (a null is passed over as least id where another is there). An empty table gives no rows. Long
texts are sketched whole, in pieces of bounded size. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, text_of
from platewise.llm.graph import merged
from platewise.llm.simjoin import _LOWER, _ODD, _WORDS, _mix, class_of, linked, with_salts
from platewise.llm.tokens import slices

SHINGLE, ROUNDS, BUCKETS, MANTISSA, BAND = 2, 25, 8, 10, 5
REGISTERS = ROUNDS * BUCKETS
EMPTY = 0xFFFF  #: a register without a shingle
DEVIATIONS = 4.5
_SEEDS = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _ODD[3])[:, None]
_NUMBER = np.arange(ROUNDS, dtype=np.uint64)[:, None] << np.uint64(59)
_STARTS = (_NUMBER | np.arange(BUCKETS, dtype=np.uint64)[None, :] << np.uint64(56)).ravel()
_KNOWN: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 2-word shingles of a text; of its word if there is but one."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    get, out = _KNOWN.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
    if len(h) == 1:
        return _mix(h * _ODD[0] + np.uint64(1))
    return np.unique(_mix(h[:-1] * _ODD[0] + h[1:] * _ODD[1] + np.uint64(2)))


def sketch(s: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """The registers of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), piece):
        z = _mix(s[None, a:a + piece] ^ _SEEDS) >> np.uint64(5) | _NUMBER
        z.sort(axis=1)
        z = z.ravel()  # in order as a whole, as the round stands in the top bits
        at = np.searchsorted(z, _STARTS)
        first = z[np.minimum(at, len(z) - 1)]
        mine = (at < len(z)) & (first >> np.uint64(56) == _STARTS >> np.uint64(56))
        np.minimum(least, np.where(mine, first, least), out=least)
    # 52 bits as a floating-point number: its exponent tells the leading zeros, its fraction starts with the mantissa
    bits = ((least & np.uint64((1 << 56) - 1)) >> np.uint64(4)).astype(np.float64).view(np.uint64)
    zeros = np.minimum(np.uint64(1074) - (bits >> np.uint64(52)), np.uint64(52))
    out = (zeros << np.uint64(MANTISSA) | bits >> np.uint64(52 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out[least == np.iinfo(np.uint64).max] = EMPTY
    return out


def estimate(x: np.ndarray, y: np.ndarray, nx, ny) -> tuple[np.ndarray, np.ndarray]:
    """(likeness, number of registers it rests on) of rows of registers x and y, of sets of nx and ny shingles.

    Least hashes of different shingles fall into the same cell of zeros and mantissa with a chance that a cell's mean
    width, 1 / (2 ln 2) of its place over 2^mantissa, and the density of both minima give.
    """
    both = ((x == EMPTY) & (y == EMPTY)).sum(axis=-1)
    used = REGISTERS - both
    share = ((x == y).sum(axis=-1) - both) / np.maximum(used, 1)
    nx, ny = np.asarray(nx, float), np.asarray(ny, float)
    chance = nx * ny / (nx + ny) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    return (share - chance) / (1 - chance), used


def may_link(x, y, nx, ny, percent: int) -> np.ndarray:
    """Whether sets may be alike enough, by their sizes and the estimate."""
    found, used = estimate(x, y, nx, ny)
    p = percent / 100
    fits = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (used > 0)
    return fits & (found >= p - DEVIATIONS * np.sqrt(p * (1 - p) / np.maximum(used, 1)))


def sketched(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, n, c, registers) per row: a hash of the text, set size, class, sketch (null for an empty set)."""
    plain = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, c, registers = [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    c.append(class_of(s)[0])
                    registers.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(n, pa.int64()), pa.array(c, pa.int64()),
                     pa.array(registers, pa.binary())], ["id", "h", "n", "c", "registers"])

    return plain.mapInArrow(run, f"id {kind}, h long, n long, c long, registers binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, c): the bands of each class that hold a shingle."""
    width, none = 2 * BAND, b"\xff" * (2 * BAND)
    keys = []
    for i in range(REGISTERS // BAND):
        band = F.substring("registers", 1 + i * width, width)
        keys.append(F.when(band != F.lit(none), F.xxhash64(band, F.lit(i))))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "c").filter("key is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def likely(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""
    rows = (pairs.join(cards.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
            .join(cards.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = may_link(_matrix(batch.column("ra")), _matrix(batch.column("rb")), batch.column("na").to_numpy(),
                              batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def rest_links(members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between different components among those that share a bucket; members: p (pivot), c, comp, n, registers,
    text, and ps, all pivots that c is with, sorted. A pair belongs to the least pivot that both are with.

    A pivot's group of more than `block` members is cut by hash, and every pair of blocks is a group. Pairs that the sketches
    do not rule out are held against the full sets in the task itself, and a link joins components there, so that no
    more links come out than components go in, and no pair is written.
    """
    many = members.groupBy("p").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = (members.join(many, "p").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("p", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "comp", "n",
                    "registers", "ps", "text"))
    rows = rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")

    def of_group(group: list) -> list:
        i, j, mine, c, comp, n = (np.array([r[k] for r in group], np.int64) for k in range(1, 7))
        x = np.frombuffer(b"".join(r[7] for r in group), np.uint16).reshape(len(group), REGISTERS)
        left, right = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
        sets, out = {}, []

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(group[k][9])
            return sets[k]

        for p in left.tolist():
            q = right[(right > p) | (i[0] != j[0])]
            q = q[(comp[q] != comp[p]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))]
            q = q[may_link(x[p], x[q], n[p], n[q], percent)] if len(q) else q
            for k in q.tolist():
                if comp[k] == comp[p] or min(set(group[p][8]).intersection(group[k][8])) != group[0][0]:
                    continue
                small, large = (full(p), full(k)) if n[p] < n[k] else (full(k), full(p))
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * common >= percent * (len(small) + len(large) - common):
                    out.append((int(c[p]), int(c[k])))
                    comp[comp == comp[k]] = comp[p]
        return out

    def run(batches):
        key, group = None, []

        def done():
            found = of_group(group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if row[:3] != key:
                    yield done()
                    key, group = row[:3], []
                group.append(row)
        yield done()

    return rows.mapInArrow(run, "a long, b long")


class Confirm:
    """Pairs of classes held against the full sets of one text each."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, scratch: Scratch, id: str, text: str, percent: int):
        plain = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
        same = (plain["h"] == wanted["h"]) & plain["id"].eqNullSafe(wanted["id"])
        self.texts = scratch.keep(plain.join(wanted, same).select("c", "text"), "texts")
        self.scratch, self.percent = scratch, percent

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs, salts = with_salts(pairs, self.scratch, name)
        return self.scratch.keep(linked(
            pairs.join(self.texts.select(F.col("c").alias("b"), "text"), "b").select("a", "salt", "b", "text"),
            salts.join(self.texts.select(F.col("c").alias("a"), "text"), "a"), self.percent, shingles), f"{name}-links")


def labelled(docs: DataFrame, id: str, text: str, percent: int, rounds: int = 3) -> DataFrame:
    """(id, n, least) per row of `docs`: set size, least id of the component."""
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    rows = scratch.keep(sketched(docs, id, text), "rows")
    classes = scratch.keep(rows.filter("n > 0").groupBy("c").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("one"), F.max("n").alias("n"),
        F.any_value("registers").alias("registers")), "classes")
    # buckets of more than one class; of those with the same members, one
    shared = banded(classes).groupBy("key").agg(
        F.count("*").alias("k"), F.bit_xor("c").alias("x"), F.bit_xor(F.xxhash64("c")).alias("y")).filter("k > 1")
    shared = scratch.keep(shared.groupBy("k", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("times")), "shared")
    members = scratch.keep(banded(classes).join(shared.select("key", "times"), "key"), "members")
    wanted = members.select("c").distinct().join(classes.select("c", "one.id", "one.h"), "c")
    confirm = Confirm(docs, wanted, scratch, id, text, percent)
    roots, held = None, None  # components so far; pairs that were looked at
    for t in range(rounds + 1):
        known = members.withColumn("comp", F.col("c")) if roots is None else members.join(roots, "c", "left").select(
            *members.columns, F.coalesce("root", "c").alias("comp"))
        mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(
            F.struct("c", "comp"), F.xxhash64("c", F.lit(t))).alias("pivot")).filter("lo != hi")
        if t < rounds:
            met = known.join(mixed.select("key", F.col("pivot.c").alias("p"), F.col("pivot.comp").alias("p_comp")), "key")
            met = met.filter("comp != p_comp").groupBy("c", "p").agg(F.sum("times").alias("k"))
            pairs = met.select("c", "k", F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b"))
            if held is not None:
                pairs = pairs.join(held, ["a", "b"], "left_anti")
            best = F.max_by(F.struct("a", "b"), F.struct("k", F.xxhash64("a", "b")))
            pairs = scratch.keep(pairs.groupBy("c").agg(best.alias("v")).select("v.a", "v.b").distinct(), f"met-{t}")
            held = pairs if held is None else held.unionByName(pairs)
            links = confirm.links(likely(pairs, classes, percent), f"round-{t}")
        else:
            # all that share a bucket share its pivot; a group per pivot has each class once
            groups = scratch.keep(known.join(mixed.select("key", F.col("pivot.c").alias("p")), "key").select(
                "p", "c", "comp").distinct(), "groups")
            cards = groups.join(groups.groupBy("c").agg(F.sort_array(F.collect_list("p")).alias("ps")), "c")
            cards = cards.join(classes.select("c", "n", "registers"), "c").join(confirm.texts, "c")
            links = scratch.keep(rest_links(cards.select("p", "c", "comp", "n", "registers", "ps", "text"), percent), "rest-links")
        if not links.isEmpty():
            roots = merged(roots, links, scratch, f"components-{t}")
    if roots is None:
        final = classes.select("c", "least")
    else:
        final = classes.join(roots, "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
        least = final.groupBy("root").agg(F.min("least").alias("first"))
        final = final.join(least, "root").select("c", F.col("first").alias("least"))
    return rows.select("id", "n", "c").join(scratch.keep(final, "final"), "c", "left").select("id", "n", "least")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """`id, n_shingles, component_id, kept` per row of `docs`: `component_id` is the least id that links reach, the row's own
    included, and `kept` says that it is the row's own."""
    return labelled(docs, id, text, percent).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")).withColumn(
        "kept", F.col(id).eqNullSafe(F.col("component_id")))
