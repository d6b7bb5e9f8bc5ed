"""Word shingles as 64-bit hashes, for batches of texts in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from marlstone.llm.common import held

WORDS_PER_SHINGLE = 5
#: Words of which a worker keeps the hash.
CACHE_WORDS = 250_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = held("shingles", _Hashes())


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every worker."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles, words lower-cased in A-Z; with fewer words, of all
    words as one; empty without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = word_hashes(words)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(codes.tobytes(), seed=len(words))], np.uint64)
    n = len(words) - k + 1
    h = codes[:n].copy()
    for i in range(1, k):
        h *= _MULTIPLIER
        h += codes[i : i + n]
    return np.unique(mix(h))


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)
