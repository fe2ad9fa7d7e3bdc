"""From raw documents to packed sequences: quality rules, near duplicates, secrets, mixing, packing.

`STAGES` lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

What each stage makes of hard rows (tested in `tests/llm`, as every stage is against a brute-force version):

* an empty table gives an empty table with the same columns;
* a null, empty or blank text has no words, so the quality rules reject it. Later stages given such rows: near duplicates
  and the secret scan keep all of them, the mix takes them by whole multiples only, and packing gives null and empty texts
  one piece that holds the end mark alone;
* a null id is an id like another, a null source a source of its own (the last in order), a null language or length stays;
* texts of any length are read whole;
* rows with words that repeat whole are near copies of each other: one stays. Of near copies the least id stays; where several
  texts share that id, the one with the least hash;
* other columns pass through as they are, whatever their names. Packing gives its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import mixing, packing, quality, secrets, simjoin
from platewise.llm.common import Scratch, table
from platewise.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the least id."""
    return simjoin.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, lengths set anew."""
    out = secrets.redact(docs, secrets.new_ledger(spark))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say, at most three times."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot tokenize, so the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
