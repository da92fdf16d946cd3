"""Quality rules against a plain computation, and the plan they compile to."""

from __future__ import annotations

import re
from collections import Counter

from velomart.llm import quality

TEXTS = [
    None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "x\ny\nx\n\nx\n \n z w \n",
    "$ # | <b> & % and * more", "the of and to in is that it for with as was", "é ö 日本 " * 30,
    "same line here\n" * 20, "w1 w2 w3 w4 w5 w6 " * 3 + " ".join(f"u{k}" for k in range(200)),
    " ".join(f"v{k}" for k in range(3000)) + " " + " ".join(f"v{k}" for k in range(3000)), "\x1f\x0b\x0c\r a\x85b", "LOUD!! WORDS!! " * 12,
]


def plain(text):
    text = text or ""
    words = [w for w in re.split("[ \x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if found[g] > 1 for k in range(5)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def test_measures(spark):
    rows = [(k, t, 5, "x") for k, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang string")
    columns = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judged(docs).select("doc_id", *columns, "kept", "failed_rules", "lang").collect()
    assert len(got) == len(rows)
    for row in got:
        assert tuple(row[c] for c in columns) == plain(TEXTS[row.doc_id]), TEXTS[row.doc_id]
        assert row.kept == (not row.base_failed and not row.failed_rules)


def test_rules(spark):
    def verdict(text, rules=quality.RULES):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return quality.judged(docs, rules).first().failed_rules

    prose = "the man and the dog went to the river in the rain of spring with a boat"
    assert verdict(prose) == []
    assert verdict(" ".join(f"{w} ###" for w in prose.split())) == ["symbols"]
    assert verdict(" ".join(f"word{k}" for k in range(80))) == ["stop_words"]
    assert verdict("the same of it\n" * 9) == ["duplicate_lines"]
    assert verdict("the " + "w" * 400) == ["word_length_high"]
    assert verdict(prose, [quality.Rule("long", "n_words / n_lines", most=3.0)]) == ["long"]
    assert set(verdict(None)) == {r.name for r in quality.RULES}


def test_one_projection_without_python(spark, capsys):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    quality.judged(docs).explain()
    plan = capsys.readouterr().out
    assert not re.search("Exchange|Python|Arrow|Pandas|Generate", plan)


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
