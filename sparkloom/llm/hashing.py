"""Vectorised 64-bit hashes of words and of runs of words: prefix sums of polynomials modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Odd multipliers; an odd number has an inverse modulo 2**64, so a prefix sum can be moved back to position 0.
BYTE_BASE = 0x9E3779B97F4A7C15
RUN_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept and grown by doubling."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = _tables[base] = tuple(both)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes that are not white space."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    return spans(raw, start, end), start, end


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end."""
    up, down = powers(BYTE_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def runs(word: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of word[i:i+length] for each i where it fits."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(RUN_BASES[which], len(word) + 1)
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])
