"""Word shingles of a batch of texts as sorted 64-bit hashes, in numpy.

Texts are UTF-8 bytes with A-Z lower-cased; a word is a maximal run of bytes
other than 0x20 and 0x09 to 0x0D, which is the same as over code points. A
word's hash is a polynomial of its bytes, taken from prefix sums.
"""

from __future__ import annotations

import numpy as np

from .words import SHINGLE_WORDS

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of a number modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            step = np.uint64(pow(self.base, len(self.held), 1 << 64))
            self.held = np.concatenate([self.held, self.held * step])
        return self.held[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    parts = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    gap = _IS_GAP[data]
    before = np.concatenate([[True], gap[:-1]])
    first, last = np.flatnonzero(before & ~gap), np.flatnonzero(~before & gap)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up(len(data)))])
    raw = (sums[last] - sums[first]) * _down(len(data))[first]
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    return mix(raw ^ mix((last - first).astype(np.uint64))), counts


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending: five words each, or all the
    words of a text with fewer; none without words."""
    hashed, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    factor = np.uint64(0xD6E8FEB86659FD93)
    n = max(0, len(hashed) - SHINGLE_WORDS + 1)
    run = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        run = run * factor + hashed[k : k + n]
    run = mix(run)
    out = []
    for start, end, count in zip((ends - counts).tolist(), ends.tolist(), counts.tolist(), strict=True):
        if count >= SHINGLE_WORDS:
            own = np.sort(run[start : end - SHINGLE_WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            value = np.uint64(count)
            for h in hashed[start:end]:
                value = np.uint64((int(value) * int(factor) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([value], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
