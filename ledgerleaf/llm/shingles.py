"""Sets of word shingles as sorted 64-bit hashes, made in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: A long text is split into words a piece at a time.
PIECE_BYTES = 1 << 22
CACHED_WORDS = 400_000

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, A-Z lower-cased; bytes.split() parts at the same six blanks."""
    data = data.lower()
    if len(data) <= PIECE_BYTES:
        found = data.split()
        return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    parts, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, min(len(data), at + PIECE_BYTES))
        end = cut.start() if cut else len(data)
        found = data[at:end].split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)))
        at = end + 1
    return np.concatenate(parts)


def shingle_set(data: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a shorter text is one shingle; no words: empty."""
    w = word_hashes(data or b"")
    n = len(w)
    if not n:
        return w
    width = min(n, SHINGLE_WORDS)
    h = w[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        h = mixed(h) * _STEP + w[k : n - width + 1 + k]
    return np.unique(mixed(h))
