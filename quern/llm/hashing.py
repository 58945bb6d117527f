"""Vectorised 64-bit fingerprints of byte runs, words and shingles.

``Prefix`` holds prefix sums of a random byte table times powers of an odd base, modulo 2**64; the hash
of any run is one subtraction and one multiplication by an inverse power, whatever its length.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
TABLES = (TABLE, _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        both = []
        for b in (BASE, INVERSE):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers, _inverse = both
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """``table`` 1 gives fingerprints that are independent of those of table 0 in their byte values."""

    def __init__(self, data: np.ndarray, table: int = 0):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLES[table][data] * p[: len(data)], out=self.sums[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, stop), by content and length."""
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one space, and where each starts (one more at the end)."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(lens)])


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    Words are runs of non-space bytes after lower-casing A-Z.  A text of fewer than n words has its
    whole sequence as one shingle, a text without words has none.
    """
    empty = np.zeros(0, np.uint64)
    if not texts:
        return []
    data, starts = join_texts(texts)
    data = LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SEPARATOR[data], [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    w = Prefix(data).runs(first, last)
    at = np.searchsorted(first, starts)
    m = max(0, len(w) - n + 1)
    rolled = w[:m]
    for k in range(1, n):
        rolled = rolled * SHINGLE_BASE + w[k : k + m]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            h = np.sort(rolled[a : b - n + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            h = np.uint64(b - a) * np.ones(1, np.uint64)
            for k in range(a, b):
                h = h * SHINGLE_BASE + w[k]
            out.append(mix(h))
        else:
            out.append(empty)
    return out
