"""Columns of numpy arrays packed as one compressed value per bucket, so that a
shuffle moves few large rows instead of a row for each n-gram."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard

GATHER_BYTES = 8 << 20


def pack(*arrays, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def gather(batches, size: int = GATHER_BYTES):
    """Record batches joined to about `size` bytes; a larger one is cut by rows."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def groups(labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, offsets): rows of each label 0..n-1, in their order."""
    order = np.argsort(labels, kind="stable")
    return order, np.searchsorted(labels[order], np.arange(n + 1))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Firsts of the runs of equal sorted keys."""
    n = len(keys[0])
    first = np.zeros(n, bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of the value at each place."""
    order = np.argsort(x)
    held = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return held[new], order[new], which


def planes(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each value as three rows of 16 bits, the high one first; sorted values compress well."""
    return np.stack([(x >> np.uint64(s)).astype(np.uint16) for s in (32, 16, 0)])


def from_planes(p: np.ndarray) -> np.ndarray:
    return p[0].astype(np.uint64) << np.uint64(32) | p[1].astype(np.uint64) << np.uint64(16) | p[2].astype(np.uint64)


def deltas(x: np.ndarray) -> np.ndarray:
    """Sorted values as the bytes of their differences, a row for each byte of eight; the high ones are mostly zero."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def from_deltas(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(rows.T).view(np.uint64).ravel(), dtype=np.uint64)
