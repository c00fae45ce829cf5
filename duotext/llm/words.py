"""Word and shingle hashes of UTF-8 texts, in numpy; used inside tasks only."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased: ``bytes`` knows exactly these blanks and letters."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, in order; of fewer words, one hash of them all."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = acc * _MULTIPLIER + hashes[i : n - k + 1 + i]
    return mixed(acc)
