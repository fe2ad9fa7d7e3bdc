"""Best-fit decreasing packing of tokenized documents into sequences (operator 2)."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, text_of
from platewise.llm.tokens import loaded, read_file, slices

PIECES = "id {0}, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest fit in logarithmic time.

    Leaf c holds the groups of bins that have c left; an inner node says how many groups its leaves hold.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.groups: list[list] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, change: int) -> None:
        node = left + self.width
        while node:
            self.count[node] += change
            node >>= 1

    def push(self, left: int, group) -> None:
        self.groups[left].append(group)
        self._add(left, 1)

    def pop(self, left: int):
        self._add(left, -1)
        return self.groups[left].pop()

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least `size` that an open bin has."""
        node = size + self.width
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a sibling to the right
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last node of its level
                return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins that best-fit decreasing makes of `counts` (items by size): (number of equal bins, [(size, items)]).

    Items of one size are alike, so they are placed together: all bins that are tightest for the size take as many as
    fit, which is what placing them one by one does, since a bin just used is tighter than any other. The work
    depends on the number of sizes, not of items.
    """
    bins = OpenBins(capacity)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = bins.tightest(size)
            number, content = (left, []) if room is None else bins.pop(room)
            each = (capacity if room is None else room) // size
            if room is None:
                number, room = max(1, left // each), capacity
            used = min(number, left // each)
            if used:
                bins.push(room - each * size, (used, [*content, (size, each)]))
                left -= used * each
            elif left:  # fewer items than one bin takes
                used = 1
                bins.push(room - left * size, (1, [*content, (size, left)]))
                left = 0
            if content and number > used:
                bins.push(room, (number - used, content))
    return [g for groups in bins.groups for g in groups]


def tokenize(docs: DataFrame, tokenizer: str, id: str, text: str, end: int, capacity: int) -> DataFrame:
    """Pieces of each document: its ids and `end`, whole if at most `capacity`, else cut into pieces of that length of
    which the first may be shorter."""
    content, kind = read_file(tokenizer), tokenizer.rsplit(".", 1)[-1]
    held = docs.sparkSession.sparkContext.broadcast(content)  # a file of fixed size
    plain = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    kind_of_id = plain.schema["id"].dataType.simpleString()

    def cut(batches):
        t = loaded(held.value, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(t.ids(part.column("text").to_pylist())):
                    ids = np.append(np.asarray(ids, dtype="<u4"), np.uint32(end)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    at = 0
                    for p, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        row.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(ids[at:stop].tobytes()))
                        at = stop
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])

    return plain.mapInArrow(cut, PIECES.format(kind_of_id))


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2,
         capacity: int = 1024) -> DataFrame:
    """`id, piece, start, length, ids_crc32, sequence_id, offset`: every piece and its place in a sequence.

    Texts are tokenized once, into a table of pieces in the shared folder. Lengths are counted (at most `capacity`
    distinct ones, whatever the input), and best-fit decreasing over these counts says which kinds of bins there are.
    Every piece gets its rank among those of its length, and ranks map to bins by arithmetic. Pieces of a length
    are ranked in several groups, so a length that many copies share is not one task's work.

    Null text is empty and gives the end token alone. Repeated rows are packed as often as they come. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(tokenize(docs, tokenizer, id, text, end, capacity), "pieces")
    total = pieces.count()
    groups = max(1, math.isqrt(total))  # so neither a group of one length nor the groups of a length are many rows
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("length", "g").agg(F.count("*").alias("n"))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _intervals(spark, best_fit(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")
    offsets = sizes.select(F.col("length").alias("l2"), F.col("g").alias("g2"), before.alias("before"))
    ranked = grouped.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "g").orderBy("id", "piece", "ids_crc32", "start")) - 1)
    placed = ranked.join(offsets, (F.col("length") == F.col("l2")) & (F.col("g") == F.col("g2")))
    placed = placed.withColumn("rank", F.col("r") + F.col("before"))
    at = F.col("rank") - F.col("from_rank")
    return (placed.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank"))
                        & (F.col("rank") < F.col("to_rank")))
            .select(F.col("id").alias(id), "piece", "start", "length", "ids_crc32",
                    (F.col("first_bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("base") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset")))


def _intervals(spark: SparkSession, bins) -> DataFrame:
    """Which ranks of a size go to which bins: one row per size and kind of bin, a few per size (so it is broadcast)."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for number, content in bins:
        base = 0
        for size, each in content:
            start = rank.get(size, 0)
            rank[size] = start + number * each
            rows.append((size, start, start + number * each, first, each, base))
            base += size * each
        first += number
    return spark.createDataFrame(
        rows, "size long, from_rank long, to_rank long, first_bin long, each long, base long")
