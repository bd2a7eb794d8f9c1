"""Weighted MinHash signatures by hashed darts.

Every element of a weighted set owns a region, its weight wide and endless along the axis of rank, and darts fall on it
at rate 1, drawn from hashes of the element: any two sets see the same darts where their regions overlap. A set
keeps the darts below a rank at which it expects k ln k + 2 k of them; each dart names one of k coordinates, and the
earliest dart of a coordinate is its value. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity, and the work is about one dart for an element and k log k for a set, not k for each element.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix

_STRIP, _DART, _COORD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) values; element: 64-bit hashes, owner: the set of each, weight: above 0. A set without elements gets zeros."""
    # Strips of width 1; the last one of an element may be narrower, and darts beside it miss.
    strips = np.ceil(weight).astype(np.int64)
    total = np.bincount(owner, weight, sets)
    at = np.repeat(np.arange(len(element)), strips)
    level = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    share = None if weight.dtype.kind in "iu" else np.minimum(weight[at] - level, 1.0)
    element, owner = mix(element[at] + level.astype(np.uint64) * _STRIP), owner[at]
    out = np.zeros((sets, k), np.uint64)
    todo, limit = total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)
    while todo.any():
        own = todo[owner]
        slot, rank, value = _darts(element[own], owner[own], None if share is None else share[own], limit, k)
        # The earliest dart of each (set, coordinate): written from the last to the first, the earliest one stays.
        order = np.argsort(rank)[::-1]
        dart = np.full(sets * k, -1)
        dart[slot[order]] = order
        filled = dart >= 0
        first = dart[filled]
        full = todo & filled.reshape(sets, k).all(1)
        keep = first[full[slot[first] // k]]
        out.reshape(-1)[slot[keep]] = value[keep]
        todo &= ~full
        limit = limit * 2
    return out


def _darts(element, owner, share, limit, k):
    """All darts below their sets' limits: slot (set * k + coordinate), rank, value.

    The darts of an element come in order of rank, a few more of them at each turn: large sets need few for each element, small ones many.
    """
    rank, slots, ranks, values, count, many = np.zeros(len(element)), [], [], [], 1, 2
    while len(element):
        draw = mix(element[:, None] + np.arange(count, count + many, dtype=np.uint64) * _DART)
        steps = np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
        steps[:, 0] -= rank
        at = -np.cumsum(steps, 1)
        row, column = np.nonzero(at < limit[owner][:, None])
        value = mix(draw[row, column] ^ _COORD)
        hit = slice(None) if share is None else (mix(value) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share[row]
        slots.append((owner[row] * k + (value % np.uint64(k)).astype(np.int64))[hit])
        ranks.append(at[row, column][hit])
        values.append(value[hit])
        alive = at[:, -1] < limit[owner]
        element, owner, rank = element[alive], owner[alive], at[alive, -1]
        share = None if share is None else share[alive]
        count, many = count + many, min(2 * many, 256)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((slots, np.int64), (ranks, float), (values, np.uint64)))
