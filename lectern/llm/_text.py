"""Vectorised text kernels over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Every kernel works
on the UTF-8 bytes of whole texts, a few megabytes of rows at a time, so memory
does not depend on the number of rows in an Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_K = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= _A
    h ^= h >> np.uint64(27)
    h *= _B
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges of about `size` bytes; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per_doc: np.ndarray  # offsets of each text's words

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.per_doc)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; injective on words of one length up to 8 bytes."""
        length = self.ends - self.starts
        h = (length.astype(np.uint64) + np.uint64(seed)) * _K
        if not len(h):
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data),), "<u8", padded, 0, (1,))
        part = eight[self.starts] & _KEEP[np.minimum(length, 8)]
        h = mix(h ^ part)
        live = np.flatnonzero(length > 8)
        at = 8
        while len(live):
            part = eight[self.starts[live] + at] & _KEEP[np.minimum(length[live] - at, 8)]
            h[live] = mix(h[live] ^ part)
            at += 8
            live = live[length[live] > at]
        return h


def words(data: np.ndarray, off: np.ndarray) -> Words:
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64))
    sep = SEPARATOR[data]
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    before = np.empty(size, bool)
    before[0] = True
    before[1:] = sep[:-1]
    starts = np.flatnonzero(~sep & (before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    ends = np.flatnonzero(~sep & (after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def shingles(h: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each start that has k words in its text, and the start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * _K + h[j : n + j])
    last = np.repeat(per_doc[1:] - k, np.diff(per_doc))[:n]
    at = np.flatnonzero(np.arange(n) <= last)
    return out[at], at


def document_of(per_doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(per_doc, at, side="right") - 1
