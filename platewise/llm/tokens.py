"""Tokenizers of public vocabulary files, and token counts through a digest cache (operator 6)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, text_of


def read_file(path: str) -> bytes:
    """A vocabulary file: a few megabytes, read on the driver and handed to the tasks."""
    with open(path, "rb") as f:
        return f.read()


LONG_RUN = 20_000  #: blanks in a row from which on a text goes to the library
_RUN = re.compile(r"\s{%d}" % LONG_RUN)


def in_order(model: dict) -> bool:
    """Whether merges come in the order of their results' numbers, so that these serve as ranks."""
    last = -1
    for m in model["merges"]:
        n = model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1)
        if n <= last:
            return False
        last = n
    return True


class Tokenizer:
    """Token ids of texts, without begin, end or added special tokens.

    `kind` is the file's ending. A byte-level BPE `.json` is run by tiktoken from the same vocabulary, which gives the
    ids that the tokenizers library gives in a third of its time (tested against it); any other `.json` by that
    library itself; a `.model` by sentencepiece. Texts with a very long run of blanks, on which the faster engine's
    stack gives out, go to the library, too. Strings of special tokens inside a text become their ids, as is
    the default of the tokenizers library.
    """

    def __init__(self, content: bytes, kind: str):
        self.fast = self.slow = self.piece = None
        self.content = content
        if kind == "model":
            import sentencepiece
            self.piece = sentencepiece.SentencePieceProcessor(model_proto=content)
            return
        spec = json.loads(content)
        model, special = spec["model"], spec.get("added_tokens") or []
        plain = (model["type"] == "BPE" and not spec.get("normalizer") and not model.get("end_of_word_suffix")
                 and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
                 and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
                 and not model.get("dropout") and not model.get("ignore_merges") and in_order(model)
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special))
        if plain:
            import public_tokenizers
            import tiktoken
            names = {t["content"]: t["id"] for t in special}
            byte = _bytes_of()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in names}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=names)
        else:
            self.library()

    def library(self):
        """The tokenizers library's own tokenizer of the file."""
        if not self.slow:
            import tokenizers
            self.slow = tokenizers.Tokenizer.from_str(self.content.decode())
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow

    def ids(self, texts: list[str]) -> Iterator:
        """For each text its ids, as a list or an array."""
        if self.fast:
            for t in texts:
                if len(t) > LONG_RUN and _RUN.search(t):
                    yield self.library().encode(t, add_special_tokens=False).ids
                else:
                    yield self.fast.encode_to_numpy(t, allowed_special="all") if t else []
        elif self.slow:
            for e in self.slow.encode_batch(texts, add_special_tokens=False):
                yield e.ids
        else:
            yield from self.piece.encode(texts)


def _bytes_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others,
    in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_LOADED: dict[str, Tokenizer] = {}


def loaded(content: bytes, kind: str) -> Tokenizer:
    """One tokenizer per worker process and file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(content, kind)
    return _LOADED[key]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of text, so that what Python makes of them stays small."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def version_of(path: str) -> str:
    """Digest of the tokenizer: a changed file is another version."""
    return hashlib.sha256(read_file(path)).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` per row of `docs`, encoding only what the cache at `cache` does not have.

    The cache is a Parquet table `(digest, version, n_tokens)` in a folder that all executors share. A text (null:
    empty) has the SHA-256 of its UTF-8 bytes as digest; copies are encoded once. Misses are appended, one commit
    for all; a lookup joins by digest, whose hot values Spark splits, and moves no text. Repeated rows give repeated
    results; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    content, kind, version = read_file(tokenizer), tokenizer.rsplit(".", 1)[-1], version_of(tokenizer)
    keyed = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).withColumn("digest", F.sha2("text", 256))
    known = _stored(spark, cache, version)
    # any row of a text will do; its text goes along once per task that has it
    missing = keyed.groupBy("digest").agg(F.any_value("text").alias("text")).join(known, "digest", "left_anti")
    held = spark.sparkContext.broadcast(content)  # a file of fixed size

    def encode(batches):
        t = loaded(held.value, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(x) for x in t.ids(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())],
                                                 ["digest", "n_tokens"])

    (missing.select("digest", "text").mapInArrow(encode, "digest string, n_tokens long")
     .withColumn("version", F.lit(version)).write.mode("append").parquet(cache))
    # written, so that the join has two plain shuffles and Spark can split a digest that very many rows have
    counts = Scratch(spark, "token-counts").keep(_stored(spark, cache, version, "n_tokens"), "counts")
    return (keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
            .join(counts, "digest")
            .select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def _stored(spark: SparkSession, cache: str, version: str, *more: str) -> DataFrame:
    """Digests (and counts) that the cache has for a version; none where there is no cache yet."""
    schema = "digest string, n_tokens long, version string"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    # two writers may have stored the same digest
    return stored.filter(F.col("version") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens")).select("digest", *more)


def new_cache(spark: SparkSession) -> str:
    return Scratch(spark, "token-cache").path("counts")
