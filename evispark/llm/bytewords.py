"""Vectorised word splitting and hashing over Arrow text columns.

Every Python-side operator of this subpackage reads its texts through this module: one Arrow batch
becomes one byte array, and words, lines, hashes and shingles come out as numpy arrays, without a
Python object per word.  A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are
lower-cased on request, other letters stay.  Hashes are 64 bits wide and depend on the bytes alone, so
they agree between executors, runs and partitions.

Null texts count as empty.  Memory is a small multiple of the batch's bytes: the hash works through
blocks of ``BLOCK`` bytes, so one very long text costs no more than its own size times a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, BLOCK + 1), dtype=np.uint64)
        have[1:] = np.uint64(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
        if n > 4 * BLOCK:
            del _POWERS[base]
    return have[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 2 << 20):
    """(first row, row after the last) of consecutive slices of about ``most`` bytes; a longer row stands alone."""
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``gaps``; no run crosses a row's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gaps[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, rows_of(start, offsets)


def rows_of(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row (as offsets cut them) that each of the ascending positions lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        low, high = int(start[at]), int(end[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * _powers(_BASE, high - low), out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (total[e] - total[s]) * _powers(_INVERSE, high - low + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the column, in text order."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    start, end, row = spans(data, offsets)
    return hash_spans(data, start, end), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a row of fewer words (but at least one) gives its whole sequence as one."""
    out, at = [], []
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    for width in range(1, k + 1):
        if width < k:
            first = begin[count == width]
        else:
            first = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
        if len(first):
            h = np.full(len(first), width, np.uint64)
            for j in range(width):
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + hashes[first + j])
            out.append(h)
            at.append(row[first])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.concatenate(out), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return h[order], at[order]
