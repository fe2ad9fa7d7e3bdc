"""Ranked lexical search by an Aho-Corasick scan of whole documents (operator 12).

No index of the documents is made. The terms of the items, each guarded by a separator on both sides, form an automaton; a
pass over the texts, every separator made alike, reads off how often each term stands in each document, as a guarded term
is found exactly where it is a whole term. A second pass, over these counts alone, weighs them and adds them up per item
through the automaton's outputs, each of which maps to the items that hold the term.

Items are dealt to blocks of about `per_block` terms, and the documents are scanned once per block, so what is broadcast is
bounded whatever the number of items. Every task keeps the best `top` documents per item of those it has seen, so the final
choice meets at most `top` rows per item and task. No pair of item and document is written.

Handling: a null or empty text has no terms, so such a document enters no count and such an item has no rows. Rows that
share an item's id are one item, their terms added up (null is an id like any other). Repeated documents are ranked each
for itself; among equal scores the lesser id comes first, a null id last. An empty table on either side gives no rows.
Texts of any length are scanned whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, parts_for, text_of
from platewise.llm.tokens import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms: runs of digits, letters A to Z and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GUARD = 32
_FOLD = bytes(b if b >= 128 or chr(b) in LOWER + "0123456789" else b + 32 if chr(b) in UPPER else _GUARD for b in range(256))


def guarded(text: str) -> bytes:
    """The text's bytes, lower-cased, each separator a blank, one blank before and one behind."""
    return b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" "


def n_terms(text: bytes) -> int:
    """Number of terms of a guarded text."""
    blank = np.frombuffer(text, np.uint8) == _GUARD
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds term number i wherever it stands between separators. Bytes are held as the letters of equal number."""
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t.decode('latin-1')} ", i)
    if terms:
        found.make_automaton()
    return found


_LOADED: dict[str, ahocorasick.Automaton] = {}


def loaded(content: bytes) -> ahocorasick.Automaton:
    """One automaton per worker process, the one in use."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = automaton(pickle.loads(content))
    return _LOADED[key]


def count_terms(docs: DataFrame, held, id: str, text: str) -> DataFrame:
    """(id, n, terms, tf) of each document that has a term: its length in terms, and the items' terms in it with counts."""
    plain = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches):
        found = loaded(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                at, lengths, terms, times = [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    t = guarded(t)
                    n = n_terms(t)
                    if n:
                        counted = Counter(map(itemgetter(1), found.iter(t.decode("latin-1")))) if len(found) else {}
                        at.append(i)
                        lengths.append(n)
                        terms.append(np.fromiter(counted.keys(), np.int32, len(counted)))
                        times.append(np.fromiter(counted.values(), np.int64, len(counted)))
                ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, k)]).astype(k)))
                         for x, k in ((terms, np.int32), (times, np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())),
                                                  pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    return plain.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>")


class Best:
    """The `top` best (item, score, id) rows per item of those added."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)  # what a score must reach
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.held.append((item, score, ids))
        self.rows += len(item)
        if self.rows > 4 * self.items * self.top + 50_000:
            self.trim()

    def trim(self) -> None:
        if not self.held:
            return
        item, score = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self.held])
        # ids in their own order, nulls last, as numbers to sort by
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -score, item))
        item, score = item[order], score[order]
        first = np.searchsorted(item, item)  # where the item's rows start
        rank = np.arange(len(item)) - first
        keep = rank < self.top
        full = rank == self.top - 1
        self.least[item[full]] = score[full]
        order = order[keep]
        self.held = [(item[keep], score[keep], ids.take(pa.array(order)))]
        self.rows = len(order)


def score_counts(counts: DataFrame, held, items: int, n_docs: int, n_all: int, top: int, cells: int = 1 << 21) -> DataFrame:
    """(item, score, id): the best documents per item that each task has seen. `held` has, per term, its weight and the
    items that it belongs to."""
    kind = counts.schema["id"].dataType.simpleString()

    def run(batches):
        weight, start, item, times = pickle.loads(held.value)
        degree = np.diff(start)
        best = Best(items, top)
        for batch in batches:
            n = batch.column("n").to_numpy()
            m = 100 - 25 + (25 * n * n_docs) // max(n_all, 1)
            step = max(1, cells // max(items, 1))
            for a in range(0, len(n), step):
                part = batch.slice(a, step)
                terms, tf = part.column("terms"), part.column("tf").flatten().to_numpy()
                each = np.diff(terms.offsets.to_numpy())
                doc, term = np.repeat(np.arange(len(each)), each), terms.flatten().to_numpy()
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[a:a + step][doc]))
                # every output of the automaton goes to each item that holds the term
                size = degree[term]
                entry = np.repeat(np.arange(len(term)), size)
                at = np.repeat(start[term] - np.cumsum(size) + size, size) + np.arange(len(entry))
                total = np.zeros(len(each) * items, np.int64)
                np.add.at(total, doc[entry] * items + item[at], gain[entry] * times[at])
                total = total.reshape(len(each), items)
                row, col = np.nonzero(total >= best.least)
                if len(row):
                    best.add(col, total[row, col], part.column("id").take(pa.array(row)))
        best.trim()
        for col, score, ids in best.held:
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(score, pa.int64()), ids],
                                             ["item", "score", "id"])

    return counts.select("id", "n", "terms", "tf").mapInArrow(run, f"item int, score long, id {kind}")


def search(docs: DataFrame, items: DataFrame, top: int = 20, id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", per_block: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents per item with a score above 0.

    With N documents that have a term, L terms in them, n in the document, df documents that have the term and tf of it in
    the document, a term adds w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))),
    m = 75 + (25 n N) div L, once for each time that the item holds it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    folded = F.translate(text_of(item_text), UPPER, LOWER)
    held = scratch.keep(items.select(F.col(item_id).alias("item"), F.explode(F.regexp_extract_all(
        folded, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")), "terms")
    blocks = parts_for(held.count(), per_block)
    out = spark.createDataFrame([], _result(items.schema[item_id].dataType, docs.schema[id].dataType, item_id, id))
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # bounded: a block of terms
        if rows:
            out = out.unionByName(_search_block(docs, rows, items.schema[item_id].dataType, scratch, b, top, id, text, item_id))
    return out


def _result(item_kind, id_kind, item_id: str, id: str) -> str:
    return f"{item_id} {item_kind.simpleString()}, rank int, {id} {id_kind.simpleString()}, score long"


def _search_block(docs: DataFrame, rows: list, item_kind, scratch: Scratch, b: int, top: int, id: str, text: str,
                  item_id: str) -> DataFrame:
    spark = docs.sparkSession
    names = list(dict.fromkeys(r["item"] for r in rows))
    number = {x: i for i, x in enumerate(names)}
    terms = sorted({r["term"] for r in rows})
    place = {t: i for i, t in enumerate(terms)}
    outputs = sorted((place[r["term"]], number[r["item"]], r["times"]) for r in rows)
    term, item, times = (np.array([x[k] for x in outputs], np.int64) for k in range(3))
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    packed = pickle.dumps([t.encode("utf-8", "surrogatepass") for t in terms])
    counts = scratch.keep(count_terms(docs, spark.sparkContext.broadcast(packed), id, text), f"counts-{b}")
    n_docs, n_all = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast(pickle.dumps((weight, start, item, times)))
    found = scratch.keep(score_counts(counts, sent, len(names), n_docs, n_all, top), f"found-{b}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, name {item_kind.simpleString()}")
    return ranked.join(labels, "item").select(F.col("name").alias(item_id), "rank", F.col("id").alias(id), "score")
