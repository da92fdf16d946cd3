"""Words of texts as 64-bit hashes, worked out for a stretch of texts at a time in numpy."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that are hashed in one go; longer texts are cut between words.
STRETCH = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_worker(name: str, make):
    """An object kept for the later tasks of this worker process."""
    kept = vars(sys.modules.setdefault("velomart_worker", types.ModuleType("velomart_worker")))
    if name not in kept:
        kept[name] = make()
    return kept[name]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Runs:
    """Words of a row of texts: where each starts and ends in ``data``, its hash, and the words of each text.

    ``tails``: the byte that was cut off a word's end, or 0.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    tails: np.ndarray


class RunHasher:
    """Finds the runs of bytes between separators and hashes them.

    The hash is a polynomial modulo 2^64 over random values of the bytes: sums of the terms up to each byte give
    that of any run, shifted by a power that the inverse takes away. One of the ``tails`` at a word's end is cut
    off if an ASCII letter comes before it.
    """

    def __init__(self, separators: bytes = WHITE, tails: bytes = b"", base: int = 0xD1342543DE82EF95):
        self.between = np.zeros(256, bool)
        self.between[list(separators)] = True
        self.letter, self.tail = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[list(range(65, 91)) + list(range(97, 123))] = True
        self.tail[list(tails)] = True
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(base, STRETCH), _powers(self.inverse, STRETCH)

    def _stretch(self, data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(data)
        if n > len(self.up):  # a single word longer than a stretch
            up, down = _powers(self.base, n), _powers(self.inverse, n)
        else:
            up, down = self.up, self.down
        change = np.flatnonzero(between[1:] != between[:-1]) + 1
        edges = np.concatenate([[] if between[0] else [0], change, [] if between[-1] else [n]]).astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        tails = np.zeros(len(ends), np.uint8)
        if self.tail.any():
            cut = np.flatnonzero(self.tail[data[ends - 1]] & (ends - starts > 1) & self.letter[data[np.maximum(ends - 2, 0)]])
            tails[cut] = data[ends[cut] - 1]
            ends[cut] -= 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * up[:n], out=sums[1:])
        return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), tails

    def runs(self, texts: list[bytes]) -> Runs:
        """Separators stand between texts too, so no word spans two."""
        data = b"\n".join(texts)
        whole = np.frombuffer(data, np.uint8)
        between = self.between[whole]
        found, at = [], 0
        while at < len(whole):
            end = min(at + STRETCH, len(whole))
            if end < len(whole):
                gaps = np.flatnonzero(between[at:end])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    further = np.flatnonzero(between[end:])
                    end = end + int(further[0]) + 1 if len(further) else len(whole)
            starts, ends, *rest = self._stretch(whole[at:end], between[at:end])
            found.append((starts + at, ends + at, *rest))
            at = end
        none = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint8)]
        starts, ends, hashes, tails = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
        closes = np.cumsum([len(t) + 1 for t in texts])
        sizes = np.diff(np.searchsorted(starts, closes), prepend=0) if len(texts) else np.zeros(0, np.int64)
        return Runs(data, starts, ends, hashes, sizes, tails)

    def words(self, texts: list[str | None]) -> Runs:
        """ASCII-lower-cased words; a null text has none."""
        return self.runs([(t or "").encode().translate(LOWER) for t in texts])


class HashIndex:
    """Numbers distinct 64-bit hashes in the order they are added; look-ups are vectorised open addressing.

    It is full when half of the slots it began with are taken: time to start anew. Until then ``reserve`` makes
    room for whatever a single text brings.
    """

    def __init__(self, digits: int = 20):
        self.most, self.count = 1 << (digits - 1), 0
        self._empty(digits)

    def _empty(self, digits: int) -> None:
        self.shift = np.uint64(64 - digits)
        self.keys = np.zeros(1 << digits, np.uint64)
        self.numbers = np.full(1 << digits, -1, np.int32)

    @property
    def full(self) -> bool:
        return self.count > self.most

    def reserve(self, more: int) -> None:
        """Double the tables until so many more hashes leave a quarter of them free."""
        digits = len(self.keys).bit_length() - 1
        while 4 * (self.count + more) > 3 << digits:
            digits += 1
        if 1 << digits > len(self.keys):
            taken = np.flatnonzero(self.numbers >= 0)
            hashes = self.keys[taken[np.argsort(self.numbers[taken])]]
            self._empty(digits)
            self.count = 0
            self.add(hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not added."""
        slot = ((hashes * GOLDEN) >> self.shift).astype(np.int64)
        out = self.numbers[slot]
        left = np.flatnonzero((self.keys[slot] != hashes) & (out >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            out[left] = self.numbers[slot[left]]
            left = left[(self.keys[slot[left]] != hashes[left]) & (out[left] >= 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number hashes that are distinct and not there yet; ``reserve`` makes room for them."""
        if 10 * (self.count + len(hashes)) > 9 * len(self.keys):
            raise ValueError("the index is full")
        slot = ((hashes * GOLDEN) >> self.shift).astype(np.int64)
        left, number = np.arange(len(hashes)), self.count + np.arange(len(hashes), dtype=np.int32)
        while len(left):
            free = left[self.numbers[slot[left]] < 0]
            self.numbers[slot[free]] = number[free]  # of several that want a slot, one gets it
            self.keys[slot[free]] = hashes[free]
            lost = self.numbers[slot[left]] != number[left]
            self.keys[slot[left[~lost]]] = hashes[left[~lost]]
            left = left[lost]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.count += len(hashes)


def by_size(texts: list[str | None], chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of a list of texts, of about so many characters each."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))
