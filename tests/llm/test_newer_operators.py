"""Operators 11 to 13 against brute-force versions, on given tables and on rows that are hard to get right."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

from platewise.llm import hyperminhash, lexsearch, merkle, queries
from platewise.llm.common import Scratch
from platewise.llm.graph import components

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
TEXTS = [
    None, "", " \n\t ", "one", "ONE", "one two", "a b c d e", "a b c d e", "A b c d e f", "a b c d e f g", "line\nline\nother line",
    "éclair \U0001f600 straße ÉCLAIR", "x" * 300_000, LONG, LONG + " end", "one,two;three-four_five", "\x00\x7f\x80 a b",
    "the cat sat on the mat. " * 30, "\n" * 5000, "p\nq r s t", "p\nq r s t u", "v\nw", "w\nv\n",
]
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, h string, leaf string, g string, rank string, "
           "key string, c string, n string, root string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None)[i % 2], (None, "", "a", "é", "b", "a")[i % 6], len(t or ""), *"abcdefgh")
            for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "a b c d e", "en", "a", None, *"abcdefgh")], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def real(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# ---- 11 HyperMinHash ---------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def word_pairs(text):
    w = WORD.findall((text or "").translate(LOWERED))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def expected_components(rows):
    """(id, size, component, kept) per row (id, text), all pairs of sets compared."""
    sets = [word_pairs(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 80 * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and group[i] != group[j]:
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    least = collections.defaultdict(list)
    for g, (d, _) in zip(group, rows):
        least[g].append(d)
    out = []
    for g, s, (d, _) in zip(group, sets, rows):
        ids = [x for x in least[g] if x is not None]
        c = (min(ids) if ids else None) if s else d
        out.append((d, len(s), c, d == c))
    return out


def found_components(df):
    out = hyperminhash.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return [tuple(r) for r in out.collect()]


def test_dedup_hard_rows(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(found_components(docs), expected_components(rows))
    assert found_components(none) == []


def test_dedup_real(real):
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    same(found_components(real), expected_components(rows))


def test_dedup_small_sets_and_chains(spark):
    """Sets of four and five pairs, whose sketches are mostly empty, and a chain whose ends are unlike."""
    texts = []
    for k in range(40):
        base = [f"s{k}x{i}" for i in range(6)]
        texts += [" ".join(base), " ".join(base[:5]), " ".join(base[1:])]
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[i:i + 30]) for i in range(0, 30, 2)]
    # near copies of one text: each unlike the next, though all are like the first
    rng = np.random.default_rng(5)
    first = [f"m{i}" for i in range(120)]
    for k in range(150):
        copy = list(first)
        for p in rng.choice(120, 5, replace=False):
            copy[p] = f"e{k}p{p}"
        texts.append(" ".join(copy))
    texts.append(" ".join(first))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(found_components(df), expected_components(rows))


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for n in (40, 400, 4000):
        off = []
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate((a[: len(a) * 9 // 10], rng.integers(0, 1 << 63, n // 10).astype(np.uint64))))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got, used = hyperminhash.estimate(hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None], len(a), len(b))
            assert used[0] > 190
            off.append(got[0] - true)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
    # unlike sets: the chance agreement is taken out
    x, y = (np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) for _ in range(2))
    assert abs(hyperminhash.estimate(hyperminhash.sketch(x)[None], hyperminhash.sketch(y)[None], 5000, 5000)[0][0]) < 0.02


def test_sketch_in_pieces():
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    assert (hyperminhash.sketch(s) == hyperminhash.sketch(s, 1000)).all()


def test_components_of_a_path(spark):
    """A path folds in few rounds, in ascending and in random order."""
    for order in (list(range(200)), np.random.default_rng(2).permutation(200).tolist()):
        scratch = Scratch(spark, "path")
        edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
        got = components(edges, scratch, "p")
        assert sorted(tuple(r) for r in got.collect()) == [(i, 0) for i in range(1, 200)]
        assert len([x for x in os.listdir(scratch.root) if x.endswith("-large")]) <= 9


# ---- 12 lexical search -------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expected_ranks(rows, items, top=20):
    terms = [collections.Counter(TERM.findall((t or "").translate(LOWERED))) for _, t in rows]
    full = [c for c in terms if c]
    n_docs, n_all = len(full), sum(sum(c.values()) for c in full)
    df = collections.Counter(t for c in full for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, collections.Counter()).update(TERM.findall((t or "").translate(LOWERED)))
    out = []
    for i, w in wanted.items():
        scores = []
        for (d, _), c in zip(rows, terms):
            m = 75 + (25 * sum(c.values()) * n_docs) // max(n_all, 1)
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in w.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def ranks(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in df.collect()]


ITEMS = [(0, "one TWO three"), (1, "a a b e"), (2, None), (3, ""), (4, "éclair straße É"), (5, "w17 w18 end"), (6, "absent"),
         (7, "x" * 300_000), (1, "cat"), (None, "cat mat line")]


def test_search_hard_rows(spark, docs, none):
    items = spark.createDataFrame([(i, t, "d") for i, t in ITEMS], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = expected_ranks(rows, ITEMS)
    same(ranks(lexsearch.search(docs, items)), want)
    same(ranks(lexsearch.search(docs, items, per_block=3)), want)  # in several blocks
    same(ranks(lexsearch.search(docs, items, top=2)), expected_ranks(rows, ITEMS, 2))
    assert ranks(lexsearch.search(none, items)) == []
    assert ranks(lexsearch.search(docs, items.limit(0))) == []


def test_search_real(spark, real):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    same(ranks(queries.op12_lexical_search(spark, SF)), expected_ranks(rows, [(r["item_id"], r["text"]) for r in items.collect()]))


def test_best_keeps_ties_of_lesser_ids():
    import pyarrow as pa
    best = lexsearch.Best(1, 3)
    for ids in ([9, 8], [7, None], [1, 2]):
        best.add(np.zeros(2, np.int64), np.full(2, 5, np.int64), pa.array(ids, pa.int64()))
        best.trim()
    assert best.held[0][2].to_pylist() == [1, 2, 7]


def test_terms_stand_alone():
    found = lexsearch.automaton([b"ab", b"b"])
    text = lexsearch.guarded("ab b,B abb xab\tb")
    assert [i for _, i in found.iter(text.decode("latin-1"))] == [0, 1, 1, 1]
    assert lexsearch.n_terms(text) == 6


# ---- 13 Merkle manifest ------------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + 3])))
        i //= 3
    return out


def expected_manifest(rows):
    def leaf(r, text):
        return sha(*[field(r[f]) for f in ("doc_id", "source", "lang", "n_chars")], field(text))

    def tampered(r):
        cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        return leaf(r, r["text"].replace("\n", "") if cut else r["text"])

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), tampered(r)) for r in rows if r["source"] == s))
              for s in sources]
    trees = [levels_of([x[2] for x in g]) for g in groups]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees)):
        for i, (there, d, x, y) in enumerate(g):
            path = path_of(tree, i) + path_of(top, k)
            for before, after in path:
                y = sha(before, y, after)
            out.append((d if there else None, x, tree[-1][0], top[-1][0], sha(*[b + a for b, a in path]), y, y == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(df):
    out = merkle.manifest(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return [tuple(r) for r in out.select(*NAMES).collect()]


def test_manifest_hard_rows(docs, none):
    want = expected_manifest([r.asDict() for r in docs.collect()])
    same(manifest(docs), want)
    assert {w[-1] for w in want} == {True, False}
    assert manifest(none) == []


def test_manifest_real(real):
    same(manifest(real), expected_manifest([r.asDict() for r in real.collect()]))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_sizes(spark, n):
    """One source, and as many sources as rows."""
    for source in ("'s'", "cast(id as string)"):
        df = spark.range(n).selectExpr("id as doc_id", f"{source} as source", "'en' as lang", "id as n_chars", "concat('t\n', id) as text")
        same(manifest(df), expected_manifest([r.asDict() for r in df.collect()]))
