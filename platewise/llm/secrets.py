"""Secret scans through an incremental blob ledger (operator 5)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import Scratch, text_of
from platewise.llm.simjoin import _among, _may_hold
from platewise.llm.tokens import slices

# Kind, pattern, group whose length counts, least length of it. The first three are the base kinds.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    # up to the END of the same kind, else of any kind of private key, whatever lies between but another BEGIN
    ("private_key", r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?s:(?!-----BEGIN ).)*?-----END \1-----|"
     r"(?s:(?!-----BEGIN ).)*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?", 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("hosted", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", 0, 20),
)
BASE = ("assign", "access", "hex")
#: A text without any of these has no match of that kind; looked for before the pattern is run.
HINTS = {"access": ("AKIA",), "private_key": ("PRIVATE KEY",), "jwt": (".eyJ",),
         "hosted": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_live_")}
FINDINGS = "blob string, kind string, start int, stop int"


def version_of(rule) -> str:
    """A rule's version: its kind and a digest of all that decides its matches."""
    return f"{rule[0]}@{hashlib.sha256(repr(rule).encode()).hexdigest()[:16]}"


def matches(text: str, rules=RULES) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each secret, in code points: leftmost non-overlapping matches per kind, short ones dropped."""
    for kind, pattern, group, least in rules:
        if kind in HINTS and not any(h in text for h in HINTS[kind]):
            continue
        if kind == "jwt":  # the pattern alone would read on to the end of a run from each of its beginnings
            yield from ((kind, a, b) for a, b in dotted(text) if b - a >= least)
            continue
        if kind == "hex":  # runs: those of full length are found without stopping at each short one
            pattern = pattern[:-1] + f"{{{least},}}"
        for m in re.finditer(pattern, text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the `jwt` pattern in one pass: runs of its characters, taken apart at the dots."""
    for run in re.finditer(r"[A-Za-z0-9_.-]+", text):
        if ".eyJ" not in run.group():
            continue
        parts, start, k = run.group().split("."), run.start(), 0
        while k + 2 < len(parts):
            at = parts[k].find("eyJ")
            if 0 <= at < len(parts[k]) - 3 and len(parts[k + 1]) > 3 and parts[k + 1].startswith("eyJ") and parts[k + 2]:
                stop = start + sum(map(len, parts[k:k + 3])) + 2
                yield start + at, stop
                start, k = stop + 1, k + 3
            else:
                start, k = start + len(parts[k]) + 1, k + 1


def cut(text: str, spans, mark: str) -> str:
    """`text` with the sorted spans (start, stop) replaced by `mark`; what overlaps an earlier span adds no mark."""
    parts, done = [], 0
    for start, stop in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, stop)
    return "".join([*parts, text[done:]])


def filter_of(blobs: DataFrame):
    """A Bloom filter of bounded size over `blob`, for all tasks."""
    return blobs.sparkSession.sparkContext.broadcast(_may_hold(blobs.select(F.xxhash64("blob").alias("k"))))


def dealt(rows: DataFrame, held, hit: bool) -> DataFrame:
    """The rows of `rows` (with a column `blob`) whose blob may be in the filter `held`, or all others."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_among(held.value, batch.column("_k").to_numpy()) == hit))

    keyed = rows.withColumn("_k", F.xxhash64("blob"))
    return keyed.mapInArrow(run, keyed.schema)


class Ledger:
    """What was scanned and found: `scanned` (blob, version) and `findings`, Parquet tables in a shared folder.

    Findings are written before the pairs are marked as scanned, so a run that ends in between scans again and loses
    nothing; readers take distinct rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self.read("scanned", "blob string, version string").distinct()

    def findings(self, versions: list[str]) -> DataFrame:
        kept = self.read("findings", FINDINGS + ", version string").filter(F.col("version").isin(versions))
        return kept.distinct()

    def todo(self, texts: DataFrame, rules=RULES) -> DataFrame:
        """(blob, rows, versions) of each blob of `texts`: how many rows have it, and the versions that the ledger lacks."""
        blobs = texts.groupBy("blob").agg(F.count("*").alias("rows"))
        have = self.scanned().groupBy("blob").agg(F.collect_set("version").alias("have"))
        every = F.array(*[F.lit(version_of(r)) for r in rules])
        return blobs.join(have, "blob", "left").select(
            "blob", "rows", F.when(F.col("have").isNull(), every).otherwise(F.array_except(every, "have")).alias("versions"))

    def found(self, texts: DataFrame, todo: DataFrame, rules=RULES) -> DataFrame:
        """Findings (with their version) of what `todo` lacks, each blob scanned once.

        A text that only one row has, and no rule has scanned, is scanned where it lies. Only those of other blobs, and the
        few that the filter takes for such, are shuffled.
        """
        versions, by_kind = {r[0]: version_of(r) for r in rules}, list(rules)
        alone = (F.col("rows") == 1) & (F.size("versions") == len(versions))
        held = filter_of(todo.filter(~alone))

        def find(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    out = []
                    given = "versions" in part.schema.names  # else all
                    wanted_by = part.column("versions").to_pylist() if given else [versions.values()] * len(part)
                    for blob, text, wanted in zip(part.column("blob").to_pylist(), part.column("text").to_pylist(),
                                                  wanted_by, strict=True):
                        use = [r for r in by_kind if versions[r[0]] in wanted]
                        out += [(blob, k, a, b, versions[k]) for k, a, b in matches(text, use)]
                    cols = list(zip(*out, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(),
                                                               pa.string()), strict=True)],
                        ["blob", "kind", "start", "stop", "version"])

        def find_here(batches):  # the filter and the rules in one Python process a task
            yield from find(b.filter(pa.array(~_among(held.value, b.column("_k").to_numpy()))) for b in batches)

        one = dealt(texts, held, True).groupBy("blob").agg(F.any_value("text").alias("text"))  # copies go along once per task
        shared = one.join(todo.filter(F.size("versions") > 0), "blob")
        here = texts.select("blob", "text", F.xxhash64("blob").alias("_k"))
        schema = FINDINGS + ", version string"
        return here.mapInArrow(find_here, schema).unionByName(
            shared.select("blob", "text", "versions").mapInArrow(find, schema))

    def scan(self, texts: DataFrame, rules=RULES) -> None:
        """Scan what `texts` (blob, text; copies allowed) has that the ledger lacks, and enter it."""
        todo = Scratch(self.spark, "unseen").keep(self.todo(texts, rules), "pairs")
        self.found(texts, todo, rules).write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("blob", F.explode("versions").alias("version")).write.mode("append").parquet(
            f"{self.folder}/scanned")


def scan(docs: DataFrame, ledger: str, id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Secrets of every row of `docs` (null text: empty): `id, n_<kind>` of the base kinds, `base_sha256`, `spans` and
    `found` (array of kind, start, stop).

    A text is a blob, named by the SHA-256 of its UTF-8 bytes. Only pairs of blob and rule version that the ledger in
    the shared folder `ledger` lacks are scanned; all findings are joined back to every row with that blob. Copies of
    a text are scanned once. The join back moves ids and digests only, and Spark splits its hot blobs.
    """
    spark = docs.sparkSession
    book = Ledger(spark, ledger)
    blobs = docs.select(text_of(text).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    book.scan(blobs, rules)
    order = F.expr("case " + " ".join(f"when kind = '{r[0]}' then {i}" for i, r in enumerate(rules)) + " end")
    per_blob = (book.findings([version_of(r) for r in rules]).withColumn("rank", order).groupBy("blob")
                .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("all")))
    # written, so that the join has two plain shuffles and Spark can split a blob that very many rows have
    per_blob = Scratch(spark, "found").keep(per_blob, "blobs")
    joined = (docs.select(F.col(id).alias("id"), F.sha2(text_of(text), 256).alias("blob"))
              .join(per_blob, "blob", "left")
              .withColumn("all", F.coalesce("all", F.expr("array()").cast(per_blob.schema["all"].dataType))))
    text_of_spans = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    base = "filter(all, x -> x.kind in (" + ", ".join(f"'{k}'" for k in BASE) + "))"
    return joined.select(
        F.col("id").alias(id),
        *[F.expr(f"cast(size(filter(all, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(text_of_spans.format(base)), 256).alias("base_sha256"),
        F.expr(text_of_spans.format("all")).alias("spans"),
        F.expr("transform(all, x -> struct(x.kind as kind, x.start as start, x.stop as stop))").alias("found"))


def redact(docs: DataFrame, ledger: str, id: str = "doc_id", text: str = "text", mark: str = "[secret]",
           rules=RULES) -> DataFrame:
    """The rows of `docs`, all columns, with the secrets of `text` replaced by `mark`; overlapping spans count as one. Rows
    without findings stay where they are."""
    spark = docs.sparkSession
    book = Ledger(spark, ledger)
    blob = F.sha2(text_of(text), 256).alias("blob")
    book.scan(docs.select(blob, text_of(text).alias("text")), rules)
    per_blob = (book.findings([version_of(r) for r in rules]).groupBy("blob")
                .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("all")))
    per_blob = Scratch(spark, "found").keep(per_blob, "blobs")

    @F.pandas_udf("string")
    def marked(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, zip(a, b, strict=True), mark)
                          for t, a, b in zip(texts, starts, stops, strict=True)], dtype=object)

    rows, held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob), filter_of(per_blob)
    # a shuffle in between, so that no task has two Python processes
    joined = dealt(rows, held, True).join(per_blob.hint("merge"), "blob", "left")
    # only texts with findings go to Python
    old = F.col(f"row.`{text}`")
    given = F.when(F.col("all").isNotNull(), old)
    new = F.coalesce(marked(given, F.col("all.start"), F.col("all.stop")), old)
    joined = joined.withColumn("new", new)
    out = joined.select(*[F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return dealt(rows, held, False).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).union(out)


def new_ledger(spark: SparkSession) -> str:
    return Scratch(spark, "ledger").root
