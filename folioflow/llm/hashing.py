"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a
polynomial over its bytes modulo 2^64 with a random table and odd base, finished by
a mixing step, so that equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MINI_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ASCII_LOWER = np.arange(256)
_ASCII_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_ASCII_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, MINI_BYTES), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * MINI_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        # read in place, as Spark gives nulls no bytes
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        if not column.null_count or not np.diff(offsets)[np.asarray(column.is_null())].any():
            body = column.buffers()[2]
            return (np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)), offsets
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def mini_batches(offsets: np.ndarray, size: int = MINI_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of some rows, and each row's first word (n + 1 bounds)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    rel = offsets - lo
    if hi == lo:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[part]
    first = np.empty(len(part) + 1, dtype=bool)
    first[0] = first[-1] = True
    first[1:-1] = space[:-1]
    cuts = rel[(rel > 0) & (rel < len(part))]
    first[cuts] = True
    starts = np.flatnonzero(~space & first[:-1])
    last = np.empty(len(part), dtype=bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[cuts - 1] = True
    ends = np.flatnonzero(~space & last) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, rel)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    total = np.empty(len(part) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        coded = (_TABLE_LOWER if lower else _TABLE).take(part)
        coded *= _power("up", _BASE, len(part))
        np.cumsum(coded, out=total[1:])
        raw = (total[ends - lo] - total[starts - lo]) * _power("down", _INVERSE, len(part))[starts - lo]
        return mix(raw + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some rows and each row's first word (n + 1 bounds)."""
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends, lower), bounds
