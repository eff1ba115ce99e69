"""Words and word shingles of whole texts, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased; byte methods touch ASCII only."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    size = min(n, len(words))
    h = word_hashes(words)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _ODD + h[k:len(h) - size + 1 + k])
    return np.unique(out)
