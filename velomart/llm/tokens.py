"""Token ids by a public tokenizer, at the cost of a look-up per word.

Both tokenizers treat what stands between single spaces and line breaks independently, so the ids of a text
are those of its units one after another. Each worker keeps the ids of the units it has met by their hash; the
tokenizer itself sees a unit once, as long as it is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from velomart.llm.words import GOLDEN, HashIndex, RunHasher, by_size, mixed, of_worker

#: A line with a Latin word, and a full stop or comma after it: both pre-tokenizers split it in the same way.
LATIN = "^([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)$"
#: White space of any script but the plain space and line break.
OTHER_SPACE = re.compile(r"[^\S \n]")
SUSPECT = np.zeros(256, bool)
SUSPECT[list({c.encode()[0] for c in map(chr, range(0x3001)) if OTHER_SPACE.match(c)})] = True
#: How a unit follows what is before it: at the start of a text, after a line break, after a space.
FIRST, AFTER_BREAK, AFTER_SPACE = 0, 1, 2


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a letter: printable ones as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the end id included.

    Without ``leading_space`` the tokenizer drops white space and lower-cases letters. With it, it is
    byte-level: a line break is a token of its own, the space before a unit belongs to the unit,
    and the first unit of a line is another word than the same unit after a space. A text with white
    space in a row, at its ends or of another kind then goes to the tokenizer whole. A null text counts as empty.
    """

    def __init__(self, path: str, leading_space: bool, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # the merges alone, for words already prepared
        self.latin = re.compile(LATIN, re.MULTILINE)
        self.letters = _byte_letters()
        self.leading_space = leading_space
        self.end = end_id
        most = max(end_id, max(self.tokenizer.get_vocab().values(), default=0))
        self.width = 2 if most < 1 << 16 else 4  # bytes that hold every id
        self.hasher = RunHasher(b" \n", b".,")
        self.stops = dict(zip(".,\n", self._direct([".", ",", "\n"]), strict=True))
        self._forget()

    @classmethod
    def of_worker(cls, path: str, leading_space: bool, end_id: int) -> UnitEncoder:
        return of_worker(f"tokens {path} {leading_space} {end_id}", lambda: cls(path, leading_space, end_id))

    def _forget(self) -> None:
        self.index = HashIndex()
        self.pool = np.zeros(1 << 16, np.uint32)  # ids of all kept units in a row
        self.bounds = np.zeros(1 << 16, np.int64)  # unit n has pool[bounds[n] : bounds[n + 1]]
        self._keep(np.array([46, 44], np.uint64), [self.stops["."], self.stops[","]])  # units 0 and 1

    @staticmethod
    def _ids(found) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in found]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return self._ids(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learnt(self, units: list[str], space: str) -> list[bytes]:
        """Ids of distinct units: Latin words by the merges alone, all else by the whole tokenizer."""
        latin = self.latin.findall("\n".join(units))
        words = list({w for w, _ in latin})
        text = "\n".join([space + w for w in words] if self.leading_space else [w.lower() for w in words])
        # Each UTF-8 byte as its letter; the line break, byte 10, is the one that maps to chr(266).
        prepared = text.encode().decode("latin-1").translate(self.letters).split("Ċ") if words else []
        known = dict(zip(words, self._ids(self.model.encode_batch_fast(prepared, add_special_tokens=False)), strict=True))
        known.update([(w + stop, known[w] + self.stops[stop]) for w, stop in latin if stop])
        rest = [u for u in units if u not in known]
        known.update(zip(rest, self._direct([space + u for u in rest]), strict=True))
        return [known[u] for u in units]

    def _keep(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        n = self.index.count
        self.index.reserve(len(hashes))
        self.index.add(hashes)
        added = np.frombuffer(b"".join(ids), np.uint32)
        ends = self.bounds[n] + np.cumsum([len(x) // 4 for x in ids])
        while len(self.bounds) < n + len(ids) + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.pool) < ends[-1]:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.bounds[n] : ends[-1]] = added
        self.bounds[n + 1 : n + 1 + len(ids)] = ends

    def _numbers(self, runs, kinds: np.ndarray) -> np.ndarray:
        """Number of each unit; those not met before are learnt first."""
        hashes = mixed(runs.hashes + kinds.astype(np.uint64) * GOLDEN)
        numbers = self.index.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            units = [runs.data[s:e].decode() for s, e in zip(runs.starts[at].tolist(), runs.ends[at].tolist(), strict=True)]
            ids: list[bytes] = [b""] * len(units)
            for kind in (FIRST, AFTER_BREAK, AFTER_SPACE):
                own = np.flatnonzero(kinds[at] == kind).tolist()
                lead = self.stops["\n"] if kind == AFTER_BREAK else b""
                for k, x in zip(own, self._learnt([units[k] for k in own], " " if kind == AFTER_SPACE else ""), strict=True):
                    ids[k] = lead + x
            self._keep(fresh, ids)
            numbers[missing] = self.index.find(hashes[missing])
        return numbers

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id."""
        texts = [t or "" for t in texts]
        for part in by_size(texts, 500_000):
            yield from self._encoded(texts[part])

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        if self.index.full:
            self._forget()
        encoded = [t.encode() for t in texts]
        runs = self.hasher.runs(encoded)
        data = np.frombuffer(runs.data, np.uint8)
        last = np.cumsum(runs.sizes)
        if self.leading_space:
            first = np.zeros(len(runs.starts), bool)
            first[(last - runs.sizes)[runs.sizes > 0]] = True
            before = data[np.maximum(runs.starts - 1, 0)] if len(data) else runs.starts
            kinds = np.where(first, FIRST, np.where(before == 10, AFTER_BREAK, AFTER_SPACE))
        else:
            kinds = np.zeros(len(runs.starts), np.int64)
        numbers = self._numbers(runs, kinds)
        cut = runs.tails > 0
        if cut.any():  # a full stop or comma cut off is the next unit
            wide = 1 + cut.astype(np.int64)
            place = np.cumsum(wide) - wide
            whole = np.zeros(int(wide.sum()), np.int64)
            whole[place], whole[place[cut] + 1] = numbers, runs.tails[cut] == 44
            numbers, last = whole, np.concatenate([[0], place + wide])[last]
        begin, size = self.bounds[numbers], self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        close = np.concatenate([[0], ends])[last]  # ids up to the end of each text
        end = np.array([self.end], "<u4").tobytes()
        spaces = self._plain(texts, runs, self._suspects(encoded, data)) if self.leading_space else [True] * len(texts)
        for text, stop, start, plain in zip(texts, close.tolist(), [0, *close[:-1].tolist()], spaces, strict=True):
            if plain:
                yield ids[start:stop].astype("<u4").tobytes() + end
            else:
                yield self._direct([text])[0] + end

    @staticmethod
    def _suspects(encoded: list[bytes], data: np.ndarray) -> list[bool]:
        """Which texts have a byte that other white space may begin with."""
        out = np.zeros(len(encoded), bool)
        out[np.searchsorted(np.cumsum([len(t) + 1 for t in encoded]), np.flatnonzero(SUSPECT[data]), side="right")] = True
        return out.tolist()

    @staticmethod
    def _plain(texts: list[str], runs, suspects: list[bool]) -> list[bool]:
        """Whether a text has single spaces and line breaks only, none at its ends, and no other white space, which
        the tokenizer would take together with those beside it."""
        single = (n == t.count(" ") + t.count("\n") + 1 for t, n in zip(texts, runs.sizes.tolist(), strict=True))
        return [not t or (one and not (odd and OTHER_SPACE.search(t))) for t, one, odd in zip(texts, single, suspects, strict=True)]
