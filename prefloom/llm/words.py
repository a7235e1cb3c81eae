"""Words of a text as numbers, for operators on shingles and windows."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

CACHED_WORDS = 500_000
# Odd multipliers that mix a word's place into the hash of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, kept for frequent use; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def split_words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than space, tab, newline, vertical tab, form feed and return; A-Z made small."""
    return raw.lower().split()


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` words in a row; of all words if there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ w[i:n - k + 1 + i]) * MIX[i % len(MIX)] + (total >> np.uint64(29))
    return np.unique(finish(total))
