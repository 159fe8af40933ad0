"""Sets of word shingles as sorted arrays of 64-bit hashes, by array operations over whole batches of text."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of these bytes: words are runs without ASCII white space, A-Z taken in lower case."""
    white = _WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASE, len(data)), _powers(_UNBASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles; of all its words if they are fewer; none without words."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(words):
        return words
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out ^ words[i : len(words) - n + 1 + i]) + np.uint64(i)
    return np.unique(out)
