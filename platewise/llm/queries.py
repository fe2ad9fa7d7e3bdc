"""Queries of the operators of this package, one each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import (
    hyperminhash, langid, lexsearch, mainhtml, merkle, mixing, packing, quality, secrets, simjoin, tokens, warc,
    winnow,
)
from platewise.llm.common import Scratch, table
from platewise.llm.sql import ORACLES  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"), Scratch(spark, "warc").path("archives"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    counts = langid.fit(docs, F.coalesce(fold != 1, F.lit(False)))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return langid.predict(docs, counts).withColumn("held_out", held_out)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.new_ledger(spark)).drop("found")


def op6_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, tokens.new_cache(spark))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op11_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_warc_index, op2_best_fit_packing, op3_ngram_jaccard_join, op4_language_id, op5_secret_ledger, op6_token_cache,
    op7_winnowing, op8_source_mix, op9_quality_rules, op10_main_text,
    op11_hyperminhash_dedup, op12_lexical_search, op13_merkle_manifest)}
