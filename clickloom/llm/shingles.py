"""Sets of five-word shingles, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: An odd factor for each place of a word in its shingle.
_AT = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, split at ASCII white space."""
    words = text.lower().split()  # of bytes, both touch ASCII alone
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingles, ascending; with fewer words the whole sequence is one; no words, no shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, len(words) if len(words) < WORDS else 0, np.uint64)
    for i in range(min(WORDS, len(words))):
        out += words[i : i + n] * _AT[i]
    out = mix(out)
    out.sort()
    new = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]
