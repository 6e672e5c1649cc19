"""Word and shingle hashing shared by the operators that compare texts.

Words are 64-bit xxHash values; a shingle mixes the hashes of its words in
order. Everything is numpy over whole documents, so Python touches each word
once (one dictionary probe).
"""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


class WordHashes(dict):
    """bytes -> 64-bit hash. The cache is emptied at ``limit`` entries, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer, element by element."""
    z = values + _MUL
    z = (z ^ (z >> _S30)) * _MIX1
    z = (z ^ (z >> _S27)) * _MIX2
    return z ^ (z >> _S31)


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009-U+000D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter sequence is one shingle, none is empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    acc = hashes[: n - width + 1].copy()
    for i in range(1, width):
        acc = (acc ^ (acc >> _S32)) * _MUL + hashes[i : n - width + 1 + i]
    return np.unique(mix(acc + np.uint64(width)))
