"""The pipeline on a whole small table: what its stages keep, and how the last one packs it."""

from __future__ import annotations

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from platewise.llm import mixing, secrets
from platewise.llm.common import Scratch, table
from tests.llm.test_operators import (
    LONG, by_hand, check_mix, measured, pairs_of, reference_tokenizer, same, slow_components,
)

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    scratch, seen = Scratch(spark, "stages"), {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = scratch.keep(stage(spark, docs, FOLDER), name)
    for name in list(seen)[:-1]:
        assert seen[name].columns == seen[""].columns
    ids = {name: collections.Counter(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in seen.items()}
    assert ids["quality_rules"] and not ids["quality_rules"] - ids[""]
    want = {c for _, n, c in slow_components(pairs_of(seen["quality_rules"]))}
    assert ids["near_duplicates"] == collections.Counter(want)
    assert ids["secret_scan"] == ids["near_duplicates"]
    assert set(ids["source_mix"]) <= set(want) and max(ids["source_mix"].values()) <= 3
    pieces = docs.collect()
    starts = collections.Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert starts == ids["source_mix"]
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    again = corpus_pipeline.run(spark, FOLDER)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, pieces))


def passes(text):
    """The rules of quality, one by one."""
    n, chars, symbols, dup, repeat, lines, stop = measured(text)
    return (n >= 50 and 100 * repeat <= 50 * n and 2 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.03
            and dup / max(1, lines) <= 0.4)


def marked(text):
    """Every code point of a secret blotted out by the plain patterns, each run of touching spans split where one starts
    at or after the end of all before it."""
    spans = sorted(m.span() for _, pattern, group, least in secrets.RULES for m in re.finditer(pattern, text, re.ASCII)
                   if len(m.group(group)) >= least)
    out, end = "", 0
    for a, b in spans:
        if a >= end:
            out += text[end:a] + "[secret]"
        end = max(end, b)
    return out + text[end:]


def whole(df):
    return collections.Counter(tuple(r) for r in df.collect())


def run_and_compare(spark, docs):
    """Each stage against a brute-force version of it, on what the stage before kept."""
    scratch, names = Scratch(spark, "brute"), docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def out(name, df):
        return scratch.keep(stages[name](spark, df, None), name)

    place = names.index("text")
    good = out("quality_rules", docs)
    assert whole(good) == collections.Counter({r: n for r, n in whole(docs).items() if passes(r[place])})

    kept = out("near_duplicates", good)
    first = {c for _, _, c in slow_components(pairs_of(good))}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first) and whole(kept) <= whole(good)

    clean = out("secret_scan", kept)
    want = collections.Counter()
    for r, n in whole(kept).items():
        text = marked(r[place])
        want[tuple(text if c == "text" else len(text) if c == "n_chars" else v for c, v in zip(names, r, strict=True))] += n
    assert whole(clean) == want

    mixed = out("source_mix", clean)
    check_mix(clean)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    at = names.index("doc_id")
    assert whole(mixed) == collections.Counter({r: copies[r[at]] for r in whole(clean) if copies[r[at]]})

    packed = out("pack_sequences", mixed).collect()
    reference, pieces = reference_tokenizer(), []
    for d, t in pairs_of(mixed):
        ids = [*reference.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        pieces += [(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                   for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    same([tuple(r)[:5] for r in packed], pieces)
    assert len({r["sequence_id"] for r in packed}) == len(by_hand([p[3] for p in pieces], 1024))
    return len(good.take(1)), packed


def test_stages_against_brute_force(spark):
    some, packed = run_and_compare(spark, table(spark, FOLDER, "documents"))
    assert some and packed


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, size long, blob string"


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["the", "of", "and", *(f"word{i}" for i in range(4000))], n, p=[0.1] * 3 + [0.7 / 4000] * 4000))


def hard_documents(spark):
    """Nulls, empty and very long texts, ties, rows that repeat whole, secrets, and columns named like those inside."""
    a, b = prose(1), prose(2)
    texts = [None, "", "   ", a, a, a + " tail", b + " password=abcdefgh1 ghp_" + "a" * 36, LONG, prose(3, 40_000), prose(4), prose(5)]
    rows = [(i, None if i % 4 == 3 else f"s{i % 3}", None if i % 2 else "en", len(t or ""), t, "r", 7, None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


def test_stages_on_hard_rows(spark):
    docs = hard_documents(spark)
    good = corpus_pipeline.quality_rules(spark, docs, None)
    kept = [r["doc_id"] for r in good.collect()]
    assert sorted(kept) == [3, 4, 5, 6, 8, 9, 10, 10]
    some, packed = run_and_compare(spark, docs)
    assert some and {r["doc_id"] for r in packed} <= {3, 6, 8, 9, 10}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows_and_null_ids(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    none = spark.createDataFrame([], SCHEMA)
    assert run(spark, none, None).count() == 0
    rows = [(None, None, None, None, prose(7), None, None, None), (1, None, None, None, prose(8), None, None, None)]
    out = run(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {None, 1}
