"""Hashes of word shingles, for the operators that compare texts as sets."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], dtype=np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over their whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, length: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``length`` words (at most 8).

    Words are what white space (ASCII) parts, with A-Z lower-cased. A text with fewer words has its whole sequence
    as one shingle; one without words has none. Two different shingles share a hash with probability 2**-64.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    length = min(length, len(hashes))
    n = len(hashes) - length + 1
    total = np.full(n, length, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            total = (total ^ hashes[j:j + n]) * _ODD[j]
            total ^= total >> np.uint64(29)
        return np.unique(mix(total))
