"""Quality rules: a table of thresholds compiled into one projection of built-in functions (operator 9).

Measures of a text (null counts as empty, so every measure is 0 and the text is rejected as too short):

* `n_words`, `word_chars`: words are runs of other than blanks; code points inside them;
* `n_symbols`: characters of `#*$%&|<>`;
* `n_stop`: words that are lower-case stop words of a few languages;
* `n_lines`, `n_dup_lines`: lines with a word, and those equal to an earlier one;
* `n_repeat_words`: words that lie in a 3-word window found twice or more, first finding included.

Rows are judged one by one: repeated rows give repeated results, an empty table an empty one, and no other column of
the input is looked at, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BLANK

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and a to in is it that for was on are as with at be this by from or an not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de un une et en du que qui pour dans est au pas sur par plus avec elle "
    "el los las y se una por con no su al lo como más del"
).split()

#: Thresholds: measure, of what (None: the measure itself), least, most.
RULES = (
    ("n_words", None, 50, None),
    ("word_chars", "n_words", 2.0, 12.0),
    ("n_symbols", "n_words", None, 0.1),
    ("n_stop", "n_words", 0.03, None),
    ("n_dup_lines", "n_lines", None, 0.4),
    ("n_repeat_words", "n_words", None, 0.5),
)


def _once(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once per row and uses it as `name` in `body`.

    A column that a lambda refers to would be computed again for each element once the optimizer has folded the
    projections together; the only element of an array is not.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def measures(text: str = "text") -> list[Column]:
    """The measures as columns, from the text column of that name."""
    t = f"coalesce(`{text}`, '')"
    words = f"regexp_extract_all({t}, '([^{BLANK}]+)', 1)".replace("\\", "\\\\")
    lines = f"filter(split({t}, '\\\\n', -1), x -> x rlike '[^{BLANK}]')".replace(BLANK, BLANK.replace("\\", "\\\\"))
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    windows = (  # (hash, place) of each 3-word window, equal ones side by side
        "case when size(w) < 3 then cast(array() as array<struct<h:bigint,i:int>>) else array_sort(transform("
        "slice(w, 1, size(w) - 2), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) as h, i as i))) end"
    )
    again = (  # places of those that have an equal neighbour
        "array_sort(transform(filter(transform(s, (x, i) -> struct(x.i as i, "
        "(i > 0 and s[greatest(i - 1, 0)].h = x.h) or (i < size(s) - 1 and s[least(i + 1, size(s) - 1)].h = x.h) as f))"
        ", x -> x.f), x -> x.i))"
    )
    covered = (  # each covers 3 words, less what the next one covers
        "aggregate(transform(p, (x, i) -> case when i < size(p) - 1 then least(3, p[least(i + 1, size(p) - 1)] - x) "
        "else 3 end), 0L, (a, x) -> a + x)"
    )
    places = _once(windows, "s", _once(again, "p", covered))
    hashes = ("case when size(w) < 3 then cast(array() as array<bigint>) else sort_array(transform("
              "slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))) end")
    # most texts repeat no window: places are sorted only where they do
    repeat = f"case when {_once(hashes, 'g', 'size(array_distinct(g)) = size(g)')} then 0L else {places} end"
    of_words = _once(words, "w", (
        "named_struct('n_words', cast(size(w) as bigint), 'n_stop', cast(size(filter(w, "
        f"x -> x in ({stop}))) as bigint), 'word_chars', cast(char_length(array_join(w, '')) as bigint), "
        f"'n_repeat_words', {repeat})"))
    of_lines = _once(lines, "l", (
        "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', "
        "cast(size(l) - size(array_distinct(l)) as bigint))"))
    return [
        F.expr(of_words).alias("of_words"),
        F.expr(of_lines).alias("of_lines"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
    ]


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    kept = F.lit(True)
    for measure, of, least, most in rules:
        base = F.lit(1.0) if of is None else F.greatest(F.col(of), F.lit(1)).cast("double")
        value = F.col(measure) / base
        if least is not None:
            kept = kept & (value >= least)
        if most is not None:
            kept = kept & (value <= most)
    return kept


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per document: `id`, the measures, `base_failed` and `kept`.

    `base_failed`: fewer than 50 words, or more than half of the words repeated. `kept` is false for these, else as
    the table of rules says.
    """
    m = docs.select(F.col(id), *measures(text)).select(
        id, "of_words.n_words", "of_words.n_stop", "of_words.n_repeat_words", "of_lines.n_lines",
        "of_lines.n_dup_lines", "of_words.word_chars", "n_symbols")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text passes; no shuffle and no join."""
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id).alias("id"), F.col(text).alias("text"))
    m = both.select("row", "id", *measures("text")).select(
        "row", "id", "of_words.*", "of_lines.*", "n_symbols")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.filter(~failed & verdict(rules)).select("row.*")
