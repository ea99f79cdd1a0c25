"""Minimal perfect hashing of 64-bit keys, built and asked many keys at a time.

Level by level every key that is left takes a place in a row of bits; a key
alone in its place stays there and the others go on to the next level.  A key's
hash is the number of ones before its place, so n keys have the hashes 0 to
n - 1.  Any other key gets some hash too or none, so keys are verified.
"""

from __future__ import annotations

import numpy as np

from .shared import mix

_U = np.uint64
#: Places for each key that is left.
ROOM = 2


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mix(np.full(1, level + 1, np.uint64))
    return (((mix(keys ^ seed) >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the hash of distinct keys."""
    bits, sizes, level = [], [], 0
    left = keys.astype(np.uint64)
    while len(left):
        size = -(-len(left) * ROOM // 64) * 64
        at = _places(left, level, size)
        alone = np.bincount(at, minlength=size)
        row = alone == 1
        bits.append(np.packbits(row, bitorder="little").view(np.uint64))
        sizes.append(size)
        left, level = left[alone[at] > 1], level + 1
    words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
    ranks = np.zeros(len(words) + 1, np.uint32)
    np.cumsum(np.bitwise_count(words), out=ranks[1:], dtype=np.uint32)
    return {"words": words, "ranks": ranks, "sizes": np.array(sizes, np.int64)}


def find(arrays: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The hash of each key; -1 for some that aren't there."""
    words, ranks = arrays["words"], arrays["ranks"]
    out = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(arrays["sizes"]):
        if not len(left):
            break
        at = _places(keys[left], level, int(size)) + base
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit & _U(1)).astype(bool)
        below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
        out[left[hit]] = (ranks[at >> 6] + below)[hit]
        left, base = left[~hit], base + int(size)
    return out
