"""Quality rules: a threshold table compiled into one projection of built-in functions.

Metrics are columns over the words and lines of a whole text; a rule bounds one of
them; ``verdict`` is the conjunction of all rules of a table.

Defined results: null text has no words and no lines; rows are judged one by one, so
repeated rows and null ids pass through; an empty table gives an empty table.  A ratio
without a denominator is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import WORD, text_of, words

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "a", "for", "that", "on", "with", "as", "it", "be",
    "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist",
    "de", "la", "le", "les", "et", "un", "une", "en", "que", "qui",
    "el", "los", "las", "y", "del", "se", "por", "con", "una",
]


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a bound of None does not bind.  ``from_words``: shorter texts are not judged by it."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Texts that break one of these are not prose.  Bounds are wide: clean prose of any of the languages is far inside.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.0, high=25.0),
    Rule("symbol_ratio", high=0.10),
    Rule("pipe_ratio", high=0.10),
    Rule("shout_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.01, from_words=50),
    Rule("dup_line_ratio", high=0.50),
    Rule("repeat_word_ratio", high=0.20),
    Rule("distinct_word_ratio", low=0.10, from_words=50),
)


def repeated_window_words(w: Column) -> Column:
    """Number of words that lie in a window of five words found at least twice, its first place included.

    Hashes of windows, put together from hashes of words, show at once that most texts repeat nothing.  Where they
    repeat, the windows themselves are sorted with their places, equal neighbours give the places, and gaps between
    places say how many words each adds.  Hashes only ever skip texts whose windows all differ, so counts are exact.
    """
    n, size = F.size(w), 5
    windows = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
    tail = lambda v, k: F.slice(v, k + 1, F.size(v))
    # zip_with pads the shorter side with nulls, so a window that runs over the end hashes apart; those are cut off
    step = lambda v, x, k: F.zip_with(v, tail(x, k), lambda a, b: F.xxhash64(a, b))

    def hashed(h: Column) -> Column:
        out = bound(step(h, h, 1), lambda two: bound(step(two, two, 2), lambda four: step(four, h, 4)))
        return F.slice(out, 1, n - (size - 1))

    pairs = lambda v, f: F.zip_with(F.slice(v, 1, F.size(v) - 1), tail(v, 1), f)

    def places(order: Column) -> Column:
        same = pairs(order, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def covered(v: Column) -> Column:
        order = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        steps = lambda at: F.aggregate(pairs(at, lambda a, b: F.least(b - a, F.lit(size))), F.lit(size), lambda t, x: t + x)
        return bound(bound(order, places), steps)

    differ = bound(bound(F.transform(w, lambda x: F.xxhash64(x)), hashed), lambda v: F.size(F.array_distinct(v)) == F.size(v))
    counted = F.when(differ, F.lit(0)).otherwise(bound(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v))))
    return F.when(n >= size + 1, counted).otherwise(F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value computed once: a one-element array binds it to a name."""
    return F.transform(F.array(value), make)[0]


def fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def counts(text: Column, w: Column, lines: Column) -> Column:
    return fields(
        n_words=F.size(w).cast("long"),
        word_chars=F.length(F.array_join(w, "")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        n_pipes=F.size(F.filter(w, lambda x: x == "|")).cast("long"),
        n_shouted=F.regexp_count(text, F.lit(r"!!")).cast("long"),
        n_stop_words=F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).cast("long"),
        n_distinct=F.size(F.array_distinct(w)).cast("long"),
        n_lines=F.size(lines).cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_repeat_words=repeated_window_words(w),
    )


def ratios(c: Column) -> Column:
    n = c["n_words"]
    return fields(
        n_words=n,
        mean_word_chars=ratio(c["word_chars"], n),
        symbol_ratio=ratio(c["n_symbols"], c["word_chars"]),
        pipe_ratio=ratio(c["n_pipes"], n),
        shout_ratio=ratio(c["n_shouted"], n),
        stop_word_ratio=ratio(c["n_stop_words"], n),
        dup_line_ratio=ratio(c["n_dup_lines"], c["n_lines"]),
        repeat_word_ratio=ratio(c["n_repeat_words"], n),
        distinct_word_ratio=ratio(c["n_distinct"], n),
    )


def verdict(r: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules over a struct of ratios as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (r[rule.metric] >= rule.low)
        if rule.high is not None:
            holds = holds & (r[rule.metric] <= rule.high)
        if rule.from_words:
            holds = holds | (r["n_words"] < rule.from_words)
        out = out & holds
    return out


def judge(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(counts, ratios, base_failed, kept) of a text in one expression."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return bound(ratios(c), lambda r: fields(counts=c, ratios=r, base_failed=failed, kept=~failed & verdict(r, rules)))

    return bound(words(text), lambda w: bound(lines, lambda x: bound(counts(text, w, x), judged)))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that hold all rules, with their own columns."""
    return docs.filter(judge(text_of(F.col(f"`{text_col}`")), rules)["kept"])


def digest(docs: DataFrame) -> DataFrame:
    m = docs.select("doc_id", judge(text_of("text")).alias("m"))
    base = [F.col(f"m.counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select("doc_id", *base, F.col("m.base_failed").alias("base_failed"), F.col("m.kept").alias("kept"))


#: ``digest`` in DuckDB SQL, with the thresholds of RULES.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
c AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
  len(list_filter(w, lambda x: x = '|')) AS n_pipes, len(regexp_extract_all(t, '!!')) AS n_shouted,
  len(list_filter(w, lambda x: list_contains(STOP, lower(x)))) AS n_stop FROM d),
s AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM c WHERE len(w) >= 6),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM s),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM g WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(r.n_repeat_words, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2 AND 25
  AND coalesce(n_symbols / nullif(word_chars, 0), 0) <= 0.10 AND coalesce(n_pipes / nullif(n_words, 0), 0) <= 0.10
  AND coalesce(n_shouted / nullif(n_words, 0), 0) <= 0.50 AND (n_words < 50 OR n_stop / n_words >= 0.01)
  AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.50 AND coalesce(n_repeat_words / nullif(n_words, 0), 0) <= 0.20
  AND (n_words < 50 OR n_distinct / n_words >= 0.10) AS kept
FROM m
""".replace("STOP", "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]")
