"""Word shingles as 56-bit hashes, for whole texts and any part of them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.uint64)


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def rolling(hashes: np.ndarray, width=WIDTH) -> np.ndarray:
    """The hash of every `width` neighbouring words, in order; of all words where there are fewer."""
    n = len(hashes)
    if not n:
        return _EMPTY
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ hashes[k:n - span + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out >> np.uint64(8)


def shingle_set(text: str, width=WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(rolling(word_hashes(words(text)), width))


def set_key(shingles: np.ndarray) -> int:
    """A 63-bit key of a set of shingles; equal sets, equal keys."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1
