"""Polynomial prefix hashes over bytes and words, in numpy.

``PrefixHash`` keeps H[i] = sum of table[byte j] * BASE^j over j < i, modulo 2^64. BASE is odd and so has an
inverse, which makes the hash of any span two look-ups, a difference and a product.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_TABLE = np.frombuffer(
    b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype=np.uint64
)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of BASE or of its inverse; doubled when a longer text comes."""
    have = _powers[kind]
    while len(have) < n:
        step = np.uint64(pow(BASE if kind == "up" else INVERSE, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class PrefixHash:
    """Hashes of any spans of one byte string."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        n = len(self.bytes)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_TABLE[self.bytes] * powers("up", n), out=self.prefix[1:])
        self.down = powers("down", n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each ``data[start:end]``."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def words_of(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, one space between two.

    ``bytes.split`` without arguments cuts at 0x20 and 0x09-0x0D only, and ``bytes.lower`` changes A-Z only.
    """
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def word_edges(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in what ``words_of`` returns."""
    if not joined:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def shingles(joined: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence where it is shorter."""
    start, end = word_edges(joined)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    last = max(len(start) - size, 0)
    return np.unique(PrefixHash(joined).spans(start[: last + 1], end[min(size, len(end)) - 1 :]))
