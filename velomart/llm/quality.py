"""Quality rules: a table of thresholds compiled into one projection, no user functions.

Words are runs of anything but ASCII white space, lines what line breaks separate. A null text
has no words and fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "be", "by", "this", "are", "from", "a", "an"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "ein", "zu", "den", "von", "auf", "für", "im", "des", "sich", "auch", "als", "eine", "sie"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "est", "que", "des", "du", "en", "dans", "pour", "qui", "sur", "au", "avec", "ce", "il"],
    "es": ["el", "la", "de", "que", "y", "en", "un", "los", "se", "no", "las", "una", "por", "con", "para", "es", "del", "lo", "al", "como"],
}
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[ \x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes when ``metric`` lies within the limits."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = [
    Rule("word_length_low", "word_chars / n_words", least=2.0),
    Rule("word_length_high", "word_chars / n_words", most=15.0),
    Rule("symbols", "n_symbols / n_words", most=0.2),
    Rule("stop_words", "(1 + n_stop_words) / n_words", least=0.02),
    Rule("duplicate_lines", "n_dup_lines / n_lines", most=0.5),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text."""

    def covered(at: Column) -> Column:
        """Words under windows at these ascending positions: each adds up to the next one's start."""
        return F.aggregate(
            F.sequence(F.lit(0), F.size(at) - 1),
            F.lit(0),
            lambda n, i: n + F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(WINDOW))),
        )

    def repeated(marked: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(marked, i)["h"] == F.get(marked, j)["h"], F.lit(False))
        twice = F.filter(marked, lambda _, i: same(i, i - 1) | same(i, i + 1))
        return _let(F.array_sort(F.transform(twice, lambda x: x["p"])), covered)

    def counted(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(marked, repeated))

    def windows(hashes: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        return _let(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at), counted)

    return F.when(
        F.size(words) >= WINDOW, _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    ).otherwise(F.lit(0))


def _measures(words: Column, lines: Column, symbols: Column) -> dict[str, Column]:
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    found = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": symbols,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))),
    }
    return {name: value.cast("long") for name, value in found.items()}


def _parts(text: Column) -> dict[str, Column]:
    """Words, lines with a word, and the number of symbols."""
    text = F.coalesce(text, F.lit(""))
    return {
        "words": F.array_remove(F.split(text, SPACE), ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")),
        "symbols": F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, "")),
    }


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words.

    Columns of these names are replaced.
    """
    parts = _parts(F.col("text"))
    measures = _measures(*[F.col(name) for name in parts])
    return docs.select(F.struct("*").alias("row"), *[value.alias(name) for name, value in parts.items()]).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in measures],
        *[value.alias(name) for name, value in measures.items()],
    )


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _failed(rule: Rule) -> str:
    """True where the metric is outside the limits; without a value (no words) the rule fails."""
    metric = f"({rule.metric.split(' / ')[0]} / cast(nullif({rule.metric.split(' / ')[1]}, 0) as double))"
    parts = [f"{metric} {sign} {limit}D" for sign, limit in (("<", rule.least), (">", rule.most)) if limit is not None]
    return f"coalesce({' OR '.join(parts)}, true)"


def judged(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rules (names) and kept, to every row and column of ``docs``.

    Columns of these names are replaced. A null or empty text fails; rows that repeat are judged each.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "failed_rules", "kept")])
    failed = ", ".join(f"CASE WHEN {_failed(r)} THEN '{r.name}' END" for r in rules)
    return (
        measured(docs)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("failed_rules", F.expr(f"array_compact(array({failed}))"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def passing(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their own columns whatever these are called.

    The verdict is one expression in which the measures are bound once, so that filtering by it, wherever the
    planner puts the filter, splits a text once.
    """
    rule = " OR ".join([f"({BASE_FAILED})", *[_failed(r) for r in rules]])
    names = re.compile(r"\b(n_[a-z_]+|word_chars)\b")
    parts = F.struct(*[value.alias(name) for name, value in _parts(F.col("text")).items()])
    measures = _let(parts, lambda p: F.struct(*[v.alias(n) for n, v in _measures(p["words"], p["lines"], p["symbols"]).items()]))
    verdict = F.expr(f"get(transform(array(measures), m -> NOT ({names.sub(r'm.\1', rule)})), 0)")
    return docs.select(F.struct("*").alias("row"), measures.alias("measures")).where(verdict).select("row.*")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    verdict = " OR ".join(_failed(r).replace("D,", ",").replace("D OR", " OR") for r in RULES)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS k FROM d
), v AS (
  SELECT doc_id, k, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS gram,
         lead(a, 4) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), g AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS found FROM v WHERE whole
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM g WHERE found > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda w: w IN ({stops}))) AS n_stop_words
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND NOT ({verdict}) AS kept
FROM m
"""


SQL = _sql()
