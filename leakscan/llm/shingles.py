"""Word shingles of texts as sorted 64-bit hashes, and their MinHash signatures, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS = 5
COORDINATES = 48
CACHE_WORDS = 200_000
_rng = np.random.default_rng(20_240_501)
_MIX = _rng.integers(1, 2**63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, size=COORDINATES, dtype=np.uint64)
_MULTIPLY = _rng.integers(1, 2**62, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 512


class WordHashes(dict):
    """64-bit hash of a word; keeps up to CACHE_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: bytes | None, cache: WordHashes, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text, A-Z lowered unless told otherwise. Words are runs without 0x20 and 0x09 to 0x0D."""
    parts = ((text or b"").lower() if lower else text or b"").split()
    return np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))


def scramble(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * _SPREAD
    return values ^ (values >> np.uint64(29))


def shingle_set(text: bytes | None, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; of the whole sequence if it is shorter; none without words."""
    hashes = word_hashes(text, cache)
    if not len(hashes):
        return hashes
    width = min(WORDS, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, width, np.uint64) * _SPREAD
    for i in range(width):
        total += scramble(hashes[i : i + count] * _MIX[i])
    return np.unique(scramble(total))


def set_name(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit token per coordinate: 58 bits of the least hash and the number of the coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        mixed = (shingles[at : at + _SLICE, None] ^ _XOR) * _MULTIPLY
        mixed ^= mixed >> np.uint64(32)
        mixed *= _SPREAD
        np.minimum(least, mixed.min(axis=0), out=least)
    return ((least & ~np.uint64(63)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
