"""Exact Jaccard join of word-shingle sets with signature trees, and its components (operator 3).

Two texts link when their sets of distinct 5-word shingles have a Jaccard likeness of at least 0.8. Texts with the same
set form a class, and all further work is on classes:

1. *Signatures.* Sets are put into size classes; any linked pair meets in the group of one size class and the next. A
   linked pair of a group differs in at most H shingles, so when shingles are dealt to more than H parts by hash, the
   pair agrees on a part. Each class sends a hash of each of its parts, packed into blocks by reducer. Parts that are
   empty for both agree too; they are sent only by sets with at most H others, which is when they could be needed. Classes
   with an equal part form a bucket. No pair is lost, and a passage that many texts share does not fill a bucket by itself,
   since all that a text has in a part must be equal. Since a shingle spoils one part at most, a linked pair agrees on as
   many parts as a set fills beyond H; a class that meets others on fewer is linked with nothing and goes.
2. *Leaders.* A bucket's leader is its least class by the bits that travel; only leaders and their classes leave the task that
   a bucket meets in. Every class is compared with the leader it shares most parts with, which is linear; verified links join dense groups of near copies into components at once.
   A pair's bitmaps of hashed shingles are held together first, and only texts of pairs that these leave open are fetched.
3. *Signature trees.* Only pairs of different components are left. All classes that share a leader form a group, so all
   that share a bucket are in one. Groups that still hold several components get a tree over their members (large ones one
   per pair of blocks), whose nodes hold OR-combined bitmaps of hashed shingles and size ranges. A dual traversal drops node
   pairs whose sizes cannot go together or whose largest possible overlap is too small, and single pairs likewise. It is done
   without texts first, to see which members have a pair that remains. These get their texts, and their pairs are held
   against the full sets in the task, where a link joins components, so that a group never gives more links than it has
   components, and no pair is written.
4. *Components* by stars (`graph.py`), in tables.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, parts_for, text_of
from platewise.llm.graph import components, merged
from platewise.llm.tokens import slices

SHINGLE = 5
ALIAS = (1 << 48) - 1  #: bits of a class name that travel with a signature; what they leave open, a join settles
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text; of all its words if it has fewer."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(h), SHINGLE)
    last = len(h) - n + 1
    total = np.full(last, n, np.uint64)
    for i in range(n):
        total += h[i:i + last] * _ODD[i]
    total = np.sort(_mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set; the first names its class."""
    a, b = np.add.reduce(_mix(s ^ _ODD[0])), np.add.reduce(_mix(s ^ _ODD[1]))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class Sizes:
    """Size classes and, for each group (a class and the next), the most shingles a linked pair differs in."""

    def __init__(self, percent: int = 80):
        self.percent = percent
        self.bounds = [1]

    def grow(self, n: int) -> None:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * 100 // self.percent + 1)

    def groups(self, n: int) -> list[tuple[int, int]]:
        """(group, H) for each group a set of n shingles is in; groups where linked sets are equal are left out."""
        self.grow(n)
        k = bisect.bisect_right(self.bounds, n) - 1
        out = []
        for g in (k - 1, k):
            if g >= 0:
                a = self.bounds[g + 1] - 1
                # |A xor B| = a + b - 2 I, and I is at least percent / (100 + percent) of a + b; b is at most a / t
                most = (a + a * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
                if most:
                    out.append((g, most))
        return out


def signatures(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """A 64-bit key per part that may have to agree with another set's."""
    out = []
    values = None
    for g, most in sizes.groups(len(s)):
        m = most + 5 + most // 20
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        if values is None:
            values = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(s ^ _ODD[2]))))
        at = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
        sums = values[at[1:]] - values[at[:-1]]
        names = np.arange(m, dtype=np.uint64) + np.uint64(g << 40)
        full = at[1:] > at[:-1]
        if full.sum() > most:  # at least one part that is not empty agrees
            sums, names = sums[full], names[full]
        out.append(_mix(sums + _mix(names + np.uint64(1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def least_met(s: np.ndarray, sizes: Sizes) -> int:
    """On how many of its signatures a set agrees with one that it links with, at least. A differing shingle spoils one
    part; so of the parts that are not empty, all but H agree, and the other set sends these, too."""
    out = []
    for _, most in sizes.groups(len(s)):
        m = most + 5 + most // 20
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        out.append(max(1, 1 + int(np.count_nonzero(part[1:] != part[:-1])) - most))
    return min(out, default=1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


# ---- passes over texts -------------------------------------------------------------------------------------------

def light(docs: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    """(id, h, n, c, need, bitmap) per row: a hash of the text, set size, class, `least_met` and bitmap."""
    plain = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        sizes = Sizes(percent)
        for batch in batches:
            for part in slices(batch, "text"):
                n, c, need, bitmaps = [], [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    c.append(class_of(s)[0])
                    need.append(least_met(s, sizes))
                    bitmaps.append(_bitmap(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), *(pa.array(x, pa.int64()) for x in (n, c, need)),
                     pa.array(bitmaps, pa.binary())], ["id", "h", "n", "c", "need", "bitmap"])

    return plain.mapInArrow(run, f"id {kind}, h long, n long, c long, need long, bitmap binary")


def buckets(docs: DataFrame, text: str, shingle_sum: int, percent: int, part_bytes: int = 12 << 20) -> DataFrame:
    """(leader, alias, k): classes that agree on a part with a different one, each with the least of those that do, and on how
    many parts. Buckets end in the task that they meet in; a leader and a class have a row per such task."""
    reducers = parts_for(shingle_sum * 6, part_bytes)  # 10 bytes for about half as many signatures as shingles
    bits = min(20, max(4, (8 * reducers).bit_length()))

    def pack(keys: list, names: list) -> pa.RecordBatch:
        key, name = np.concatenate(keys), np.concatenate(names)
        r = (key >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        r, key, name = r[order], key[order], name[order] & np.uint64(ALIAS)
        at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True])))
        rows = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            k, c = key[a:b], name[a:b]
            # 32 bits of a key beside those of r: what these leave open makes a few more classes meet, and none fewer
            rows.append(b"".join(x.tobytes() for x in (
                k.astype("<u4"), c.astype("<u4"), (c >> np.uint64(32)).astype("<u2"))))
        return pa.RecordBatch.from_arrays([pa.array(r[at[:-1]], pa.int32()), pa.array(rows, pa.binary())], ["r", "block"])

    def send(batches):
        sizes, keys, names, held = Sizes(percent), [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    s = shingles(t)
                    if len(s):
                        k = signatures(s, sizes)
                        keys.append(k)
                        names.append(np.full(len(k), class_of(s)[0], np.int64).view(np.uint64))
                        held += len(k)
                        if held > 600_000:
                            yield pack(keys, names)
                            keys, names, held = [], [], 0
        if held:
            yield pack(keys, names)

    def meet(batches):
        keys, names = [], []
        for batch in batches:
            for r, block in zip(batch.column("r").to_pylist(), batch.column("block"), strict=True):
                raw = np.frombuffer(block.as_buffer(), np.uint8)
                n = len(raw) // 10
                low, c_low, c_high = np.split(raw, [4 * n, 8 * n])
                keys.append(low.view("<u4").astype(np.uint64) | np.uint64(r << 32))
                names.append(c_low.view("<u4").astype(np.uint64) | c_high.view("<u2").astype(np.uint64) << np.uint64(32))
        if not keys:
            return
        key, name = np.concatenate(keys), np.concatenate(names)
        del keys, names
        order = np.argsort(key)
        key, name = key[order], name[order]
        shared = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        key, name = key[shared], name[shared]  # most signatures are alone
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[new], name[new]  # copies of a text count once
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return
        first = np.repeat(name[start[size > 1]], size[size > 1])
        name = name[keep]
        order = np.lexsort((name, first))
        first, name = first[order], name[order]
        at = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (name[1:] != name[:-1]), [True])))
        first, name, k = first[at[:-1]], name[at[:-1]], np.diff(at)
        for a in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([_signed(x[a:a + 200_000]) for x in (first, name, k)], ["leader", "alias", "k"])

    packed = docs.select(text_of(text).alias("text")).mapInArrow(send, "r int, block binary")
    return packed.repartition(reducers, "r").mapInArrow(meet, "leader long, alias long, k long")


def _bitmap(s: np.ndarray) -> bytes:
    """Bits of hashed shingles, at least four times as many as shingles, but 64 to 16384."""
    bits = 1 << min(14, max(6, (4 * len(s) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(_mix(s) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _may_hold(keys: DataFrame, most_bits: int = 1 << 27, block: int = 1 << 15) -> bytes:
    """A Bloom filter of one hash over the longs `k` of `keys`: 64 bits or more per row, `most_bits` (16 MB) at most,
    whatever the input. Past some 10 million rows it lets more through, and never keeps a row of `keys` back.

    Blocks of it are made in tasks, each of at most `block` distinct places; the driver puts them in a row.
    """
    bits = min(most_bits, max(block, 1 << (64 * keys.count()).bit_length()))
    places = keys.select(F.pmod("k", F.lit(bits)).alias("place")).distinct().withColumn(
        "block", F.expr(f"place div {block}"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(block, np.uint8)
        marks[pdf["place"] % block] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    out = bytearray(bits // 8)
    for r in places.groupBy("block").applyInPandas(fold, "block long, marks binary").collect():
        out[r["block"] * block // 8:(r["block"] + 1) * block // 8] = r["marks"]
    return bytes(out)


def _among(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """For each of `keys` whether it may be among those that the filter `raw` was made of."""
    marks = np.frombuffer(raw, np.uint8)
    place = keys % (8 * len(marks))
    return (marks[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `texts` whose id may be one of `wanted`, so that few others are shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(_may_hold(wanted.select(F.xxhash64("id").alias("k"))))
    names = texts.columns

    def run(batches):
        for batch in batches:
            yield batch.select(names).filter(pa.array(_among(held.value, batch.column("_k").to_numpy())))

    return texts.withColumn("_k", F.xxhash64("id")).mapInArrow(run, texts.schema)


def stored_texts(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(c, text) of the classes of `wanted` (c, id, h), from one text each: that of a row with this id and hash. A text takes
    less room than the hashes of its set, which are made again where they are compared."""
    plain = docs.select(F.col(id).alias("row_id"), text_of(text).alias("text")).withColumn("row_h", F.xxhash64("text"))
    plain = plain.withColumn("id", F.xxhash64("row_id", "row_h"))
    keyed = wanted.select("c", F.xxhash64("id", "h").alias("key"), F.col("id").alias("of_id"), F.col("h").alias("of_h"))
    likely = _likely(plain, keyed.select(F.col("key").alias("id"))).withColumnRenamed("id", "key")
    # one condition, of which Spark makes no keys: so the texts, dealt by `key`, are not dealt again for the groups below
    same, no_id = F.col("row_h") == F.col("of_h"), F.col("row_id").isNull() & F.col("of_id").isNull()
    named = likely.join(keyed, "key").filter(F.coalesce((F.col("row_id") == F.col("of_id")) & same, no_id & same))
    return named.groupBy("key", "c").agg(F.first("text").alias("text")).drop("key")  # rows may be repeated


def cards_of(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(c, n, bitmap) of the classes `held` (c), from rows with these columns."""
    likely = _likely(rows.select(F.col("c").alias("id"), "n", "bitmap"), held.select(F.col("c").alias("id")))
    return (likely.withColumnRenamed("id", "c").groupBy("c").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
            .join(held, "c", "left_semi"))


# ---- pairs -------------------------------------------------------------------------------------------------------

def with_salts(pairs: DataFrame, scratch: Scratch, name: str, per_leader: int = 500) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) with a salt, and the number of salts per a: a's text is sent once per `per_leader` pairs."""
    pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
    salts = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / per_leader).cast("int").alias("salts")), f"{name}-salts")
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    return pairs.join(salts, "a").select("a", "b", salt.alias("salt")), salts


def linking(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are alike enough."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def linked(followers: DataFrame, leaders: DataFrame, percent: int, sets=shingles) -> DataFrame:
    """Pairs (a, b) whose sets link, of followers (a, salt, b, text of b) and leaders (a, salts, text of a); `sets` makes
    the sorted hashes of a text's set."""
    first = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           F.lit(None).cast("long").alias("b"), "text")
    # the leader's row first (null b), then its followers, in a stream
    rows = first.unionByName(followers).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def compare(batches):
        whole, leader = None, None
        for batch in batches:
            out = []
            for a, b, t in zip(*(batch.column(k) for k in ("a", "b", "text")), strict=True):
                a, b, s = a.as_py(), b.as_py(), sets(t.as_py())
                if b is None:
                    leader, whole = a, s
                    continue
                if leader != a:
                    raise ValueError("a text is missing")
                if linking(s, whole, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long")


def may_link(n: int, u: bytes, k: int, v: bytes, percent: int) -> bool:
    """Whether two sets, of n and k shingles and with bitmaps u and v, may be alike enough: a bit that only one of them
    has stands for a shingle, at least, that the other lacks."""
    width = min(len(u), len(v)) // 8
    u, v = (np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width)) for x in (u, v))
    most = min(n - int(np.bitwise_count(u & ~v).sum()), k - int(np.bitwise_count(v & ~u).sum()))
    return most * (100 + percent) >= percent * (n + k)


def open_pairs(pairs: DataFrame, salts: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of `pairs` (a, b, salt) that may link by sizes and bitmaps; cards: c, n, bitmap."""
    first = (salts.join(cards.withColumnsRenamed({"c": "a", "n": "n_a", "bitmap": "bitmap_a"}), "a")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    both = pairs.join(cards.withColumnRenamed("c", "b"), "b").join(first, ["a", "salt"])

    def run(batches):
        for batch in batches:
            ok = [may_link(*row, percent) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "n_a", "bitmap_a", "n", "bitmap").mapInArrow(run, "a long, b long")


class Node:
    """A node of a signature tree: OR of the bitmaps below, range of sizes, most shingles beyond set bits, and the
    component if there is only one below."""

    __slots__ = ("bits", "low", "high", "extra", "comp", "kids", "rows")

    def __init__(self, bits, low, high, extra, comp, kids, rows):
        self.bits, self.low, self.high, self.extra, self.comp = bits, low, high, extra, comp
        self.kids, self.rows = kids, rows


class SignatureTree:
    """Tree over sets given by size, bitmap (rows of 64-bit words) and component."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, rows: np.ndarray, leaf: int = 16, fan: int = 8):
        self.n, self.bits, self.comp = n, bits, comp
        self.extra = n - np.bitwise_count(bits).sum(axis=1)
        rows = rows[np.lexsort((n[rows], bits[rows, 0], comp[rows]))]  # alike ones side by side
        level = [self._node(rows[i:i + leaf], None) for i in range(0, len(rows), leaf)]
        while len(level) > 1:
            level = [self._node(np.concatenate([k.rows for k in level[i:i + fan]]), level[i:i + fan])
                     for i in range(0, len(level), fan)]
        self.root = level[0]

    def _node(self, rows, kids) -> Node:
        comps = self.comp[rows]
        one = int(comps[0]) if (comps == comps[0]).all() else None
        return Node(np.bitwise_or.reduce(self.bits[rows]), int(self.n[rows].min()), int(self.n[rows].max()),
                    int(self.extra[rows].max()), one, kids, rows)


def tree_pairs(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (of x, of y) of different components that may link, by traversing both trees at once; the trees share
    their arrays, and may be the same one."""
    n, bits, comp = x.n, x.bits, x.comp
    todo = [(x.root, y.root)]
    while todo:
        a, b = todo.pop()
        if a.comp is not None and a.comp == b.comp:
            continue
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            continue
        # a common shingle sets a common bit; those beyond one per bit are at most what a set has more than bits
        most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.extra, b.extra)
        if most * (100 + percent) < percent * (a.low + b.low):
            continue
        if a.kids is None and b.kids is None:
            p, q = a.rows[:, None], b.rows[None, :]
            open_ = comp[p] != comp[q]
            if a is b:
                open_ &= p < q
            i, j = np.nonzero(open_)
            i, j = a.rows[i], b.rows[j]
            u, v = bits[i], bits[j]
            overlap = np.minimum(n[i] - np.bitwise_count(u & ~v).sum(axis=1), n[j] - np.bitwise_count(v & ~u).sum(axis=1))
            ok = overlap * (100 + percent) >= percent * (n[i] + n[j])
            if ok.any():
                yield i[ok], j[ok]
        elif a is b:
            todo += [(p, q) for i, p in enumerate(a.kids) for q in a.kids[i:]]
        elif b.kids is None or (a.kids is not None and len(a.rows) >= len(b.rows)):
            todo += [(k, b) for k in a.kids]
        else:
            todo += [(a, k) for k in b.kids]


def dealt(members: DataFrame, block: int = 1024) -> DataFrame:
    """`members` with the groups (bucket, i, j) that each belongs to, and its own block `mine`. A bucket of more than `block`
    members is cut into blocks by hash, and every pair of blocks is a group of its own, so that no task holds a bucket of
    any size."""
    many = members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    return (members.join(many, "bucket").withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other"))


def _pairs_of(group: dict[str, list], percent: int, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a group that trees leave open, of different components in `comp`, which may change meanwhile. A
    pair belongs to the least bucket that it shares."""
    n, mine, bucket = np.array(group["n"], np.int64), np.array(group["mine"]), group["bucket"][0]
    x, y = np.flatnonzero(mine == group["i"][0]), np.flatnonzero(mine == group["j"][0])
    if not len(x) or not len(y):
        return
    others = [set(b) for b in group["buckets"]]
    width = min(len(b) for b in group["bitmap"])
    bits = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8)) for b in group["bitmap"]])
    left = SignatureTree(n, bits, comp, x)
    right = left if group["i"][0] == group["j"][0] else SignatureTree(n, bits, comp, y)
    for p, q in tree_pairs(left, right, percent):
        for u, v in zip(p.tolist(), q.tolist(), strict=True):
            if comp[u] != comp[v] and min(others[u] & others[v]) == bucket:
                yield u, v


def _by_group(rows: DataFrame, names: list[str], of_group, schema: str) -> DataFrame:
    """What `of_group` makes of the columns `names` of each group (bucket, i, j) of at least two rows."""
    names = ["bucket", "i", "j", *names]

    def run(batches):
        key, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                if row[:3] != key:
                    if len(group) > 1:
                        yield of_group(dict(zip(names, zip(*group, strict=True), strict=True)))
                    key, group = row[:3], []
                group.append(row)
        if len(group) > 1:
            yield of_group(dict(zip(names, zip(*group, strict=True), strict=True)))

    rows = rows.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(run, schema)


def open_members(rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, i, j, c) of the rows of groups (see `dealt`; with n, bitmap, comp and buckets, all that c is in) that have a
    pair which the trees leave open."""
    def of_group(group) -> pa.RecordBatch:
        comp, seen = np.array(group["comp"], np.int64), set()
        for pair in _pairs_of(group, percent, comp):
            seen.update(pair)
        at = sorted(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([group[k][x] for x in at], t) for k, t in _GROUP.items()], list(_GROUP))

    return _by_group(rows, ["mine", "c", "n", "bitmap", "comp", "buckets"], of_group, "bucket long, i int, j int, c long")


_GROUP = {"bucket": pa.int64(), "i": pa.int32(), "j": pa.int32(), "c": pa.int64()}


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among rows of groups, with the columns of `open_members` and text: pairs
    that the trees leave open are held against the full sets."""
    def of_group(group) -> pa.RecordBatch:
        comp, sets, found = np.array(group["comp"], np.int64), {}, []

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(group["text"][k])
            return sets[k]

        for u, v in _pairs_of(group, percent, comp):
            # components join as links are found, so most pairs of a group of near copies need no look
            if linking(full(u), full(v), percent):
                found.append((group["c"][u], group["c"][v]))
                comp[comp == comp[v]] = comp[u]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_group(rows, ["mine", "c", "n", "bitmap", "comp", "buckets", "text"], of_group, "a long, b long")


def across(members: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links (a, b) between different components among classes that share a bucket; members: bucket, c, n, bitmap, comp, text
    and buckets (all that c is in, sorted)."""
    rows = dealt(members, block)
    return confirmed(rows.join(open_members(rows, percent), list(_GROUP), "left_semi"), percent)


# ---- results -----------------------------------------------------------------------------------------------------

def labelled(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(id, h, n, c, root, least) per row of `docs`: hash of the text, set size, class, component and least id in it; the
    last two are null where the set is empty."""
    scratch = Scratch(docs.sparkSession, "simjoin")
    rows = scratch.keep(light(docs, id, text, percent), "rows")
    classes = scratch.keep(rows.filter("n > 0").groupBy("c").agg(
        F.min("id").alias("id"), F.max("need").alias("need"), F.min(F.struct("id", "h")).alias("of")), "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    # classes that share a bucket share its leader: a group per leader has each class once, not once per bucket
    met = buckets(docs, text, total, percent).groupBy("leader", "alias").agg(F.sum("k").alias("k"))
    names = classes.withColumn("alias", F.col("c").bitwiseAND(F.lit(ALIAS))).select("alias", "c", "need")
    heads = names.groupBy(F.col("alias").alias("leader")).agg(F.min("c").alias("a"))
    met = scratch.keep(met.join(names, "alias").join(heads, "leader").select("a", "c", "k", "need"), "met")
    # a class that meets others on too few parts is linked with nothing
    held = met.groupBy("c").agg(F.sum("k").alias("k"), F.max("need").alias("need")).filter("k >= need").select("c")
    held = scratch.keep(held, "held")
    groups = scratch.keep(met.select("a", "c", "k").join(held, "c", "left_semi"), "groups")
    cards = scratch.keep(cards_of(rows.filter("n > 0"), held), "cards")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        wanted = scratch.keep(wanted.distinct().join(classes, "c").select("c", "of.id", "of.h"), f"{name}-wanted")
        return scratch.keep(stored_texts(docs, wanted, id, text), f"{name}-texts")

    # every class meets one leader, that with which it shares most buckets
    best = F.max_by("a", F.struct("k", -F.col("a").cast("decimal(20,0)")))
    pairs = groups.filter("a != c").join(held.withColumnRenamed("c", "a"), "a", "left_semi")
    pairs, salts = with_salts(pairs.groupBy("c").agg(best.alias("a")).select("a", F.col("c").alias("b")), scratch, "met")
    pairs, salts = with_salts(open_pairs(pairs, salts, cards, percent), scratch, "leader")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("c")), "leader")
    links = scratch.keep(linked(
        pairs.join(texts.withColumnRenamed("c", "b"), "b").select("a", "salt", "b", "text"),
        salts.join(texts.withColumnRenamed("c", "a"), "a").select("a", "salts", "text"), percent), "leader-links")
    roots = components(links, scratch, "leader")
    # groups that still hold several components
    known = groups.join(roots, "c", "left").select(F.col("a").alias("bucket"), "c", F.coalesce("root", "c").alias("comp"))
    known = scratch.keep(known.join(groups.groupBy("c").agg(F.collect_list("a").alias("buckets")), "c"), "known")
    mixed = scratch.keep(known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                         .filter("lo != hi").select("bucket"), "mixed")
    members = scratch.keep(dealt(known.join(mixed, "bucket")), "members")
    seen = scratch.keep(open_members(members.join(cards, "c"), percent), "open")
    texts = texts_of(seen.select("c"), "tree")
    few = _likely(cards.withColumnRenamed("c", "id"), seen.select(F.col("c").alias("id"))).withColumnRenamed("id", "c")
    more = scratch.keep(confirmed(members.join(seen, list(_GROUP), "left_semi").join(few, "c").join(texts, "c"), percent),
                        "tree-links")
    roots = merged(roots, more, scratch, "tree")
    final = classes.join(roots, "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    final = scratch.keep(final, "final")
    least = scratch.keep(final.groupBy("root").agg(F.min("id").alias("least")), "least")
    labels = scratch.keep(final.join(least, "root").select("c", "root", "least"), "labels")
    return rows.join(labels, "c", "left").select("id", "h", "n", "c", "root", "least")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """`id, n_shingles, component_id` per row of `docs`.

    `component_id` is the least id that links reach, the row's own included; a text without words has no shingles, no
    links, and its own id. Rows with equal sets are linked, so repeated rows are; ids may repeat or be null (a null
    is passed over as least id where another is there). An empty table gives no rows.
    """
    return labelled(docs, id, text, percent).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def in_doubt(keyed: DataFrame, goes: DataFrame, stays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of `keyed` (with a long `_k`), those whose key is surely none of `goes`, and those whose key may be one of
    either (both: long `k`). A key of `goes` that is surely none of `stays` needs no further look, nor does its row."""
    context = keyed.sparkSession.sparkContext
    held, safe = (context.broadcast(_may_hold(x)) for x in (goes, stays))

    def rows(yes: bool):
        def run(batches):
            for batch in batches:
                keys = batch.column("_k").to_numpy()
                on = _among(held.value, keys)
                yield batch.filter(pa.array(on & _among(safe.value, keys) if yes else ~on))
        return keyed.mapInArrow(run, keyed.schema)

    return rows(False), rows(True)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which one per component stays: that with the least id (of several texts under
    that id the least by hash, of repeated rows one). Rows without words all stay."""
    scratch = Scratch(docs.sparkSession, "first")
    labels = scratch.keep(labelled(docs, id, text, percent), "labels")
    rows = labels.filter("n > 0")
    first = scratch.keep(rows.filter(F.col("id").eqNullSafe(F.col("least"))).groupBy("root").agg(
        F.min(F.struct("h", "id")).alias("v")), "first")
    # rows that go, and those of which one stays; all others are let through as they are
    named = rows.groupBy("id", "h", "root").agg(F.count("*").alias("rows")).join(first, "root").select(
        "id", "h", "rows", (F.col("v.h").eqNullSafe(F.col("h")) & F.col("v.id").eqNullSafe(F.col("id"))).alias("stays"))
    named = scratch.keep(named.filter("not stays or rows > 1").select(
        F.col("id").alias("_of"), F.col("h").alias("_hash"), "stays"), "named")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), F.col(id).alias("_id"), F.xxhash64(text_of(text)).alias("_h"))
    keyed = keyed.withColumn("_k", F.xxhash64("_id", "_h"))
    # whatever does not go: rows of which one stays, all others, and those without words
    left = labels.join(named.filter("not stays"), F.col("id").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_hash")),
                       "left_anti").select(F.xxhash64("id", "h").alias("k"))
    plain, maybe = in_doubt(keyed, named.select(F.xxhash64("_of", "_hash").alias("k")), scratch.keep(left, "left"))
    maybe = maybe.join(named, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_hash")), "left")
    one = maybe.filter("stays").withColumn("_n", F.row_number().over(
        Window.partitionBy("_h", "_id").orderBy(F.xxhash64("_row"))))
    out = plain.select("_row.*").unionByName(maybe.filter("stays is null").select("_row.*"))
    return out.unionByName(one.filter("_n = 1").select("_row.*"))
