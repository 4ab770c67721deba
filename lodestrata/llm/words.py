"""Words inside tasks: longest runs of ASCII letters, digits and underscores, found on UTF-8 bytes.

A byte table turns every other byte into a blank, so that splitting runs in C. ``folded`` also lowers ASCII letters;
since words are cut out first, no other letter can become an ASCII one.
"""

from __future__ import annotations

import string

import numpy as np

_WORD = set((string.ascii_letters + string.digits + "_").encode())
KEPT = bytes(b if b in _WORD else 0x20 for b in range(256))
FOLDED = KEPT.lower()

#: Odd base of the polynomial hashes modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None, table: bytes) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words; the same word has the same hash in every task. Remembers up to ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        import xxhash

        self.hash, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, given the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)
