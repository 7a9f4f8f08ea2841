"""A bounded per-worker cache of what a tokenizer makes of each distinct word or chunk.

Tokenizers that never join across a boundary can be asked once for each distinct chunk; a slice's results
are then gathered by numpy. The cache grows up to ``limit`` bytes with the chunks that come first (common ones
do); later ones are encoded again for each slice of text, so memory stays bounded and results whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Bytes of a cache, and chunks that the tokenizer gets at once.
LIMIT_BYTES, AT_ONCE = 32 << 20, 4096
#: Bytes of text that are looked up at once: the arrays of a slice are many times its size.
SLICE = 256 << 10


class _Ragged:
    """Rows of values of one type: where each begins, how many it has, and all values in one array."""

    def __init__(self, dtype):
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)

    def more(self, made: Sequence) -> "_Ragged":
        out = _Ragged(self.flat.dtype)
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        if self.flat.dtype == np.uint8:
            values = np.frombuffer(b"".join(made), np.uint8)
        else:
            values = np.fromiter((v for m in made for v in m), self.flat.dtype, int(sizes.sum()))
        out.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes])
        out.size, out.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, values])
        return out

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.size[rows].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(self.begin[rows] - ends + counts, counts)
        at += np.arange(len(at))
        return self.flat[at], counts

    @property
    def bytes(self) -> int:
        return self.begin.nbytes + self.size.nbytes + self.flat.nbytes


class PieceCache:
    """encode: for each of ``dtypes``, the values of each of a list of chunks (given as bytes); uint8 values as bytes."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence]], dtypes=(np.uint32,), limit: int = LIMIT_BYTES):
        self.encode, self.limit = encode, limit
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.fields = [_Ragged(d) for d in dtypes]

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each field: all values of the chunks, one chunk after another, and their number for each chunk."""
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == uniq[hit]
        slot = np.empty(len(uniq), np.int32)
        slot[hit] = self.slot[at[hit]]
        fields, new = self.fields, np.flatnonzero(~hit)
        if len(new):
            slot[new] = len(self.fields[0].begin) + np.arange(len(new))
            made: list[list] = [[] for _ in fields]
            for a in range(0, len(new), AT_ONCE):
                of = first[new[a : a + AT_ONCE]]
                chunks = [data[s:e].tobytes() for s, e in zip(start[of].tolist(), end[of].tolist(), strict=True)]
                for whole, part in zip(made, self.encode(chunks), strict=True):
                    whole += part
            fields = [f.more(m) for f, m in zip(fields, made, strict=True)]
            if sum(f.bytes for f in fields) + 12 * (len(self.keys) + len(new)) <= self.limit:
                self.fields = fields
                self.keys, self.slot = np.insert(self.keys, at[new], uniq[new]), np.insert(self.slot, at[new], slot[new])
        rows = slot[inverse]
        return [f.gather(rows) for f in fields]
