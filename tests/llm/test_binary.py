"""Token files: an exact round trip, random access, the dictionary beside the files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from velomart.llm import binary
from velomart.llm.common import read_blobs
from velomart.llm.registry import VOCABULARIES
from velomart.llm.tokens import UnitEncoder

BYTES = f"{VOCABULARIES}/byte_bpe_50k.json"


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(binary, "FILE_BYTES", 300)
    texts = [None, "", "a short one", "the words of a longer text. " * 40, "two\nlines", "  odd  spaces "] * 4
    rows = [(k * 7 % 24, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x"), (3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    files = binary.write_token_files(docs, BYTES, end_id=2)
    got = binary.read_token_files(spark, files).orderBy("start").collect()
    own = Tokenizer.from_file(BYTES)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = [own.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in ordered]
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == expected
    assert [r.start for r in got] == np.cumsum([0, *map(len, expected)])[:-1].tolist()
    assert [r.n_tokens for r in got] == list(map(len, expected))

    again = binary.open_token_files(spark, files.path)
    assert again.dictionary == files.dictionary
    contents = [bytes(r.blob) for r in read_blobs(spark, f"{files.path}/files").collect()]
    assert len(contents) > 3
    opened = sorted((binary.TokenFile(c, again.dictionary) for c in contents), key=lambda f: (f.partition, f.place))
    assert [f.ids(k).tolist() for f in opened for k in range(len(f.index))] == expected


def test_empty_table(spark):
    files = binary.write_token_files(spark.createDataFrame([], "doc_id long, text string"), BYTES, end_id=2)
    assert binary.read_token_files(spark, files).count() == 0


def test_file_without_dictionary_and_wide_ids():
    rows = [(1, np.array([70_000, 1], "<u4").tobytes()), (None, np.array([2], "<u4").tobytes())]
    file = binary.TokenFile(binary.file_bytes(rows, b"", 4, 0, 0) + b"\0", b"")
    assert [file.ids(k).tolist() for k in range(2)] == [[70_000, 1], [2]]
    assert file.index["has_id"].tolist() == [1, 0]
    with pytest.raises(ValueError, match="70000"):
        binary.file_bytes(rows, b"", 2, 0, 0)


def test_ids_of_texts_with_any_white_space():
    """100,000 odd texts, given as the tokenizers library gives them."""
    own, encoder, rng = Tokenizer.from_file(BYTES), UnitEncoder(BYTES, True, 2), random.Random(9)
    parts = ["a", "word", "Wörter,", "end.", "x1", "—", " ", " ", "\n", "\n", "\u00a0", "\u2028", "\u3000", "\t", "\r\n", "\x0b", "\x1f", "\x85", "\u200b", "\ufeff"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(100_000)]
    texts += ["a \u00a0 \u00a0 b", "word\n\u00a0\nword"]
    expected = [x.ids + [2] for x in own.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
    assert encoder.width == 2
