"""Vectorised word and n-gram hashing over many UTF-8 texts at once.

Texts are joined into one byte array, and a word's hash is the difference of two prefix sums of
``byte * B**i`` scaled back by ``B**-start`` (all modulo 2**64), then mixed. Words are
``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import string

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64

BLOCK = 1 << 18  # bytes hashed at once

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept between calls but for those beyond a block."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(BLOCK + 1, n), base, U64)
        factors[0] = 1
        held = np.cumprod(factors, dtype=U64)
        if n <= BLOCK + 1:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """The words of some texts, in order: ``text`` (joined by one space, texts by a line feed),
    ``start`` and ``end`` offsets into it, ``hash``, and ``count`` of words for each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True):
        split = [t.lower().split() if lower else t.split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.text = b"\n".join([b" ".join(w) for w in split])
        data = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero((data == 32) | (data == 10))
        start = np.concatenate(([0], gaps + 1))
        end = np.concatenate((gaps, [len(data)]))
        full = end > start
        self.start, self.end = start[full], end[full]
        #: Position of each text's first word.
        self.first = np.cumsum(self.count) - self.count
        if hashed:
            self.hash = spans(data, self.start, self.end)

    @classmethod
    def normal(cls, text: bytes) -> Words:
        """Of one byte string that is joined already: texts by line feeds, words by spaces, no
        text and no word empty."""
        self = cls.__new__(cls)
        self.text = text
        data = np.frombuffer(text, np.uint8)
        line = data == 10
        gaps = np.flatnonzero((data == 32) | line)
        self.start, self.end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        last = np.concatenate((np.flatnonzero(line[gaps]), [len(gaps)]))
        self.count = np.diff(np.concatenate(([-1], last)))
        self.first = np.cumsum(self.count) - self.count
        self.hash = spans(data, self.start, self.end)
        return self

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The index of the text that holds each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span. Spans are in order; as many as fill a block (one at least) are hashed
    at once, which changes no hash, as that does not depend on where the sums begin."""
    out, i = np.zeros(len(start), U64), 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        s, e = start[i:j] - base, end[i:j] - base
        n = int(e[-1])
        sums = np.zeros(n + 1, U64)
        np.cumsum((data[base : base + n].astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
        h = (sums[e] - sums[s]) * powers(INVERSE, n + 1)[s]
        out[i:j] = mix(h + (e - s).astype(U64) * U64(0xA24BAED4963EE407))
        i = j
    return out


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(string.punctuation.encode())] = True


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the ASCII punctuation at their ends; empty ones where nothing else is."""
    n = len(data)
    solid = ~PUNCTUATION[data]
    place = np.arange(n)
    after = np.append(np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1], n)
    before = np.maximum.accumulate(np.where(solid, place, -1)) if n else place
    start = np.minimum(after[start], end)
    return start, np.maximum(before[end - 1] + 1, start) if n else end


def rolling(h: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each ``width`` consecutive values of ``h`` (it runs across texts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= U64(base)
        out += h[k : k + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out[:n]
