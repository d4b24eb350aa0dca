"""Suffix arrays of many short strings at once, in numpy.

The strings of a shard lie one after another in ``data``; string k is ``data[offsets[k]:offsets[k + 1]]``. A suffix
ends with its string, a shorter one sorts before a longer one that it begins, and equal suffixes by position.
"""

from __future__ import annotations

import numpy as np

HEAD = 7


def remaining(offsets: np.ndarray) -> np.ndarray:
    """Bytes from every position to the end of its string."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by Larsson and Sadakane's refinement.

    Suffixes are first grouped by their leading bytes. Each round sorts the groups that still hold several by the
    group of what follows the part compared, which doubles that part; suffixes alone in their group rest.
    """
    n = len(data)
    rest = remaining(offsets)
    padded = np.concatenate([data, np.zeros(HEAD, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(HEAD):
        key = (key << np.uint64(8)) | np.where(rest > k, padded[k : k + n], np.uint64(0))
    key = (key << np.uint64(8)) | np.minimum(rest, HEAD).astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(n, np.int64)
    group[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = HEAD
    while places.size:
        at = order[places]
        own = group[at]
        # a suffix that ends within the part compared equals the others of its group, so its position decides
        onward = np.where(rest[at] > depth, group[np.minimum(at + depth, n - 1)], at - n)
        by = np.argsort(own * (2 * n) + onward + n)
        at, onward = at[by], onward[by]
        order[places] = at
        new = np.ones(places.size, bool)
        new[1:] = (own[1:] != own[:-1]) | (onward[1:] != onward[:-1])
        group[at] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        places = places[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, after Kasai.

    Taken in text order, a suffix shares at least one byte less with its neighbour than the suffix one byte
    earlier; exactly one less where the bytes before the two agree. Only the others are compared, eight bytes at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    rest = remaining(offsets)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.zeros(n, bool)
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.arange(n)
    compare = (before < 0) | head | head[before] | (data[at - 1] != data[before - 1])
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n + 8]
    own = np.flatnonzero(compare & (before >= 0))
    other = before[own]
    most = np.minimum(rest[own], rest[other])
    shared = np.zeros(own.size, np.int64)
    open_ = np.arange(own.size)
    while open_.size:
        differ = words[own[open_] + shared[open_]] ^ words[other[open_] + shared[open_]]
        equal = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
        shared[open_] = np.minimum(shared[open_] + equal, most[open_])
        open_ = open_[(equal == 8) & (shared[open_] < most[open_])]
    known = np.zeros(n, np.int64)
    known[own] = shared
    source = np.maximum.accumulate(np.where(compare, at, 0))
    return (known[source] - (at - source))[order]
