"""64-bit hashes of all words of many texts at once.

A word's bytes are a polynomial in a fixed odd base, read off running sums over a whole
stretch of text, so no word becomes an object of its own. Words beyond ``LONG_WORD`` bytes,
where such polynomials can be made to agree, are hashed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

LONG_WORD = 64
#: Bytes hashed in one go.
STRETCH = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VERY_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (LONG_WORD + 1))
_CUT = re.compile(rb"[\x20\x09-\x0D]")


class Base:
    """One hash function: a value for every byte, and the powers of its base."""

    def __init__(self, salt: int):
        rng = np.random.default_rng((salt, 17))
        self.salt = salt
        self.bytes = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
        self.base, self.odd = (int(v) | 1 for v in rng.integers(1 << 60, 1 << 63, 2, dtype=np.uint64))
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(max(len(data), 1))
        values = self.bytes[data]
        values *= up
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(self.odd)
        h += (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(29)
        return h


def _chunks(texts: list) -> Iterator[tuple[int, bytes]]:
    """(number of the text, bytes), long texts cut at white space."""
    for i, text in enumerate(texts):
        data = (text or "").encode()
        a = 0
        while a < len(data):
            cut = _CUT.search(data, a + STRETCH) if len(data) - a > STRETCH else None
            b = cut.start() if cut else len(data)
            yield i, data[a:b]
            a = b


def _stretches(texts: list) -> Iterator[tuple[list[int], list[bytes]]]:
    owners, parts, size = [], [], 0
    for i, chunk in _chunks(texts):
        if parts and size + len(chunk) > STRETCH:
            yield owners, parts
            owners, parts, size = [], [], 0
        owners.append(i)
        parts.append(chunk)
        size += len(chunk) + 1
    if parts:
        yield owners, parts


def word_hashes(texts: list, bases: list[Base]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of all texts, one after another, under each base; and the number of words of each text."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in bases]
    counts = np.zeros(len(texts), np.int64)
    for owners, parts in _stretches(texts):
        long: list[tuple[int, bytes]] = []
        if len(parts) == 1 and len(parts[0]) > 2 * STRETCH:  # a very long word, which stands as one byte
            shrunk = 0

            def held(m: re.Match) -> bytes:
                nonlocal shrunk
                long.append((m.start() - shrunk, m[0]))
                shrunk += len(m[0]) - 1
                return b"x"

            parts = [_VERY_LONG.sub(held, parts[0])]
        data = b" ".join(parts)
        array = np.frombuffer(data, np.uint8)
        word = np.zeros(len(array) + 2, np.int8)
        word[1:-1] = ~_SPACE[array]
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not long:
            long = [(a, data[a:b]) for a, b in zip(*((e[ends - starts > LONG_WORD]).tolist() for e in (starts, ends)), strict=True)]
        for base, found in zip(bases, out, strict=True):
            h = base.words(array, starts, ends)
            for at, text in long:
                h[np.searchsorted(starts, at)] = xxhash.xxh3_64_intdigest(text, seed=base.salt)
            found.append(h)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        np.add.at(counts, np.array(owners)[np.searchsorted(begins, starts, "right") - 1], 1)
    return [np.concatenate(f) for f in out], counts
