"""Word shingles as 64-bit hashes, and MinHash signatures of their sets.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A set has the distinct
shingles of ``width`` words; a text of fewer words has its whole sequence as the only shingle; a
text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    value = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        value = _mixed(value * _PRIME + hashes[k : len(words) - n + 1 + k])
    return np.unique(value)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``count`` 32-bit permutations, by rule."""
    k = np.arange(1, count + 1, dtype=np.uint64)
    return (_mixed(k * _PRIME) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_mixed(k * _SECOND) >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], count: int, at_once: int = 1 << 18) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row each, ``at_once`` shingles at a time."""
    factors, shifts = permutations(count)
    out = np.full((len(sets), count), 0xFFFFFFFF, dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= at_once):
            held += len(sets[j])
            j += 1
        whole = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        for first in range(0, len(whole), at_once) if j == i + 1 else (0,):
            flat = whole[first : first + at_once] if j == i + 1 else whole
            buffer = np.empty_like(flat)
            own = np.empty(j - i, dtype=np.uint32)
            for m in range(count):
                np.multiply(flat, factors[m], out=buffer)
                np.add(buffer, shifts[m], out=buffer)
                np.minimum.reduceat(buffer, starts, out=own)
                np.minimum(out[i:j, m], own, out=out[i:j, m])
        i = j
    return out


def shared(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return len(np.intersect1d(left, right, assume_unique=True))
