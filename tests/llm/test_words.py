"""Hashed words and tokenizer ids against plain Python and the tokenizers themselves."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from velomart.llm import lm
from velomart.llm.registry import VOCABULARIES
from velomart.llm.tokens import UnitEncoder
from velomart.llm.words import LOWER, STRETCH, HashIndex, RunHasher

ODD = [
    "", " ", "a  b", " x", "x ", "<|endoftext|> b", "It's don't 12.5 É École ÉCOLE. Straße, ﬁ éa ́x\n\n y \t z", "ΣΑΣ İstanbul",
    "a b c　d  ", "\n a", "a \nb", "a\n b", "the. The, the.. the.,", "x" * 3000 + ".", "$$$ok. a.b. 1. é. 日本語。 日本.", None,
]


def test_words_are_those_of_python():
    texts = [*ODD, "w " * 100, "Y" * (STRETCH + 5) + " b c " + "d" * STRETCH]
    found = RunHasher().words(texts)
    expected = [(t or "").encode().translate(LOWER).split() for t in texts]
    assert found.sizes.tolist() == [len(w) for w in expected]
    flat = [w for words in expected for w in words]
    assert [found.data[s:e] for s, e in zip(found.starts, found.ends, strict=True)] == flat
    named = dict(zip(found.hashes.tolist(), flat, strict=True))
    assert len(named) == len(set(flat))
    assert [named[h] for h in found.hashes.tolist()] == flat


def test_no_texts_and_empty_texts():
    assert RunHasher().words([]).sizes.tolist() == []
    assert RunHasher().words(["", None]).sizes.tolist() == [0, 0]


def test_index_numbers_in_order():
    rng = np.random.default_rng(1)
    index, keys = HashIndex(12), np.unique(rng.integers(1, 1 << 63, 2500).astype(np.uint64))
    index.add(keys[:1000])
    index.add(keys[1000:])
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert (index.find(rng.integers(1, 1 << 63, 500).astype(np.uint64)) == -1).all()
    with pytest.raises(ValueError, match="full"):
        index.add(np.arange(5000, dtype=np.uint64))


@pytest.mark.parametrize(("file", "byte_level"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_tokenizers(file, byte_level):
    encoder, own = UnitEncoder(f"{VOCABULARIES}/{file}", byte_level, 7), Tokenizer.from_file(f"{VOCABULARIES}/{file}")
    for _ in range(2):  # learnt, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(ODD)]
        assert got == [own.encode(t or "", add_special_tokens=False).ids + [7] for t in ODD]
    encoder.index.count = len(encoder.index.keys)  # full: all is forgotten
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(ODD)] == got


def test_index_makes_room_and_keeps_its_numbers():
    index, keys = HashIndex(4), np.arange(1, 5001, dtype=np.uint64)
    for part in np.split(keys, [3, 9, 10, 700]):
        index.reserve(len(part))
        index.add(part)
    assert index.find(keys).tolist() == list(range(5000))
    assert index.full and (index.find(keys + np.uint64(5000)) == -1).all()


def test_a_text_of_more_distinct_words_than_the_index_has_room():
    """1.2 million, for the tokens and for the scores; what follows is as before."""
    long = " ".join(map(str, range(1_200_000)))
    file = f"{VOCABULARIES}/byte_bpe_50k.json"
    encoder, own = UnitEncoder(file, True, 7), Tokenizer.from_file(file)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(["1 2 3", long, "3 2 1"])]
    assert got == [own.encode(t, add_special_tokens=False).ids + [7] for t in ("1 2 3", long, "3 2 1")]
    segment = lm.Filter.segment(np.arange(5, dtype=np.uint64), np.ones(5, np.int64), 1 << 20)
    bits = lm.Filter.of_segments(np.frombuffer(segment, np.uint8), np.array([8 * len(segment)], np.uint64))
    scorer = lm.Scorer(bits, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 5, 5)
    short, whole, again = (scorer.rows([t])[0] for t in ("1 2 3", long, "1 2 3"))
    assert whole[0] == 1_200_001 and len(whole[4]) == 1_200_001
    assert again[:4] == short[:4] and len(scorer.index.keys) == 1 << 20
