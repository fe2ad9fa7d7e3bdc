"""Language identification by prediction by partial matching (operator 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.tokens import slices

ORDER = 4  #: a byte is coded in the context of the three before it
_LETTER = regex.compile(r"\p{L}")
_DROP = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b).isspace()))
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", b" " * 9)
_LEAD = b" " * (ORDER - 1)


def letters_of(text: str) -> bytes:
    """What is coded: lower-case UTF-8 without digits, signs and control characters, blanks as spaces."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE, _DROP)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Code of the k bytes that end at each place from the (ORDER-1)-th on."""
    out = np.zeros(len(data) - ORDER + 1, np.uint32)
    for i in range(k):
        start = ORDER - k + i
        out = out << 8 | data[start:start + len(out)]
    return out


def count_grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k from 1 to ORDER: distinct k-grams and how often each comes."""
    parts = [np.frombuffer(_LEAD + letters_of(t), np.uint8) for t in texts if t]
    out = []
    for k in range(1, ORDER + 1):
        grams = [_grams(p, k) for p in parts if len(p) >= ORDER]
        out.append(np.unique(np.concatenate(grams), return_counts=True) if grams else
                   (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    return out


class Model:
    """Frozen context trees of all languages, laid out as arrays.

    A node is a k-gram seen in any language; `child[k]` leads from the node of a context and a byte to the node of the
    longer gram (0: none). `cost[k]` has, for each node and language, the bits that its last byte takes in the context
    of the ones before; where the language has not seen it there, the escape from that context and the bits in the
    next shorter one. `escape[k]` is the escape from a context. Escapes follow method C: with n bytes of d kinds seen
    in a context, an escape has probability d / (n + d). The last resort is 8 bits.
    """

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        self.child, self.cost, self.escape = [], [], []
        levels = {ORDER + 1: np.zeros(0, np.uint32)}
        for k in range(ORDER, 0, -1):  # with a gram, the context and the shorter gram in it
            longer = levels[k + 1]
            levels[k] = np.unique(np.concatenate([*(counts[x][k - 1][0] for x in self.langs), longer >> 8,
                                                  longer & np.uint32(256 ** k - 1) if k < ORDER else longer]))
        levels[1] = np.arange(256, dtype=np.uint32)
        known = None
        for k in range(1, ORDER + 1):
            codes = levels[k]
            contexts = (codes >> 8).astype(np.uint32)
            parent = np.zeros(len(codes), np.int64) if k == 1 else np.searchsorted(known, contexts) + 1
            n_parents = 1 if k == 1 else len(known) + 1
            child = np.zeros(n_parents * 256, np.int32)
            child[parent * 256 + (codes & 255)] = np.arange(1, len(codes) + 1)
            cost = np.zeros((len(codes) + 1, n_langs), np.float32)
            escape = np.zeros((n_parents, n_langs), np.float32)
            if k > 1:
                shorter = np.searchsorted(self._codes, codes & np.uint32(256 ** (k - 1) - 1)) + 1
            for j, lang in enumerate(self.langs):
                seen, n = counts[lang][k - 1]
                c = np.zeros(len(codes))
                c[np.searchsorted(codes, seen)] = n
                total = np.bincount(parent, c, n_parents)
                kinds = np.bincount(parent, c > 0, n_parents)
                with np.errstate(divide="ignore"):
                    escape[:, j] = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0)
                    own = -np.log2(c / np.maximum((total + kinds)[parent], 1))
                less = 8.0 if k == 1 else self.cost[-1][shorter, j]
                cost[1:, j] = np.where(c > 0, own, escape[parent, j] + less)
            self.child.append(child)
            self.cost.append(cost)
            self.escape.append(escape)
            self._codes = known = codes

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        data = np.frombuffer(b"".join(_LEAD + texts[i] for i in full), np.uint8)
        lengths = np.array([len(texts[i]) for i in full])
        starts = np.cumsum(lengths + ORDER - 1) - lengths  # of the bytes proper
        # nodes of the grams of length k that end at each place
        node = [data.astype(np.int64) + 1]
        for k in range(1, ORDER):
            longer = np.zeros(len(data), np.int64)
            longer[1:] = self.child[k][node[-1][:-1] * 256 + data[1:]]
            node.append(longer)
        lost = [np.flatnonzero(n == 0) for n in node]
        for j in range(len(self.langs)):
            cost = self.cost[ORDER - 1][:, j][node[-1]]
            # from the longest context down: escape where nothing was seen after it
            for k in range(ORDER - 1, 0, -1):
                at = lost[k]
                at = at[at > 0]
                if not len(at):
                    break
                cost[at] += self.escape[k][:, j][node[k - 1][at - 1]] + self.cost[k - 1][:, j][node[k - 1][at]]
            sums = np.concatenate(([0.0], np.cumsum(cost, dtype=np.float64)))
            out[full, j] = sums[starts + lengths] - sums[starts]
        return out


def fit(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_lang: int = 150, most_bytes: int = 65536) -> dict:
    """Gram counts per language, from a bounded sample of labelled rows: the `per_lang` first by a hash of the id, of
    texts of at most `most_bytes`, among the rows that `learn` admits. A label without such rows is not learned."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()
                       & (F.octet_length(text) <= most_bytes)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.lit("fit")).alias("h"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(
        F.col("n") <= per_lang)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = count_grams(pdf["text"].tolist())
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(ORDER),
                             "grams": [g.astype("<u4").tobytes() for g, _ in grams],
                             "counts": [n.astype("<i8").tobytes() for _, n in grams]})

    out: dict = {}
    # four rows per label, of a size that the sample bounds
    for r in first.groupBy("lang").applyInPandas(count, "lang string, k int, grams binary, counts binary").collect():
        out.setdefault(r["lang"], [None] * ORDER)[r["k"]] = (
            np.frombuffer(r["grams"], "<u4"), np.frombuffer(r["counts"], "<i8"))
    return {x: c for x, c in out.items() if len(c[0][0])}


def predict(docs: DataFrame, counts: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, lang_pred, score` per row of `docs`, from the whole text and nothing else.

    The language with the shortest code wins, the first by name among equals; `score` is its share when each language
    weighs two to the minus its code length. `und` with score 0: null, no letter, or nothing learned. A text
    whose letters were all dropped does not arise: letters are kept. Rows do not depend on each other, so repeated rows
    give repeated results and an empty table an empty one; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by the sample
    made: list[Model] = []
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()

    def score(batches):
        if not made and held.value:
            made.append(Model(held.value))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = part.num_rows
                names, scores = ["und"] * n, [0.0] * n
                if made:
                    known = [bool(_LETTER.search(t)) for t in texts]
                    bits = made[0].bits([letters_of(t) if ok else b"" for t, ok in zip(texts, known, strict=True)])
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
                    for i in range(n):
                        if known[i]:
                            names[i], scores[i] = made[0].langs[best[i]], float(share[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "lang_pred", "score"])

    return plain.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)
