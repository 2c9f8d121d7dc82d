"""Vectorised tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` over code points because those bytes never occur inside
a UTF-8 sequence.  All hashes are 64 bits wide.  Work goes in chunks of CHUNK_BYTES
of whole documents; one document is never split.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: So many bytes of whole documents are worked on together; numpy holds some fifty bytes for each meanwhile.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _cache.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, 1 << 18)
        up, down = _powers(_BASE, size), _powers(_BASE_INV, size)
        if size > 8 * CHUNK_BYTES:
            return up, down
        _cache["up"], _cache["down"] = up, down
    return _cache["up"], _cache["down"]


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, giving its memory back when it ends: Spark keeps the worker, and its next task may be of another stage."""

    def run(batches):
        yield from rows(batches)
        _cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of several documents: byte ranges, hashes, and each document's range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the documents that ``offsets`` cuts ``data`` into."""
    n = len(data)
    n_docs = len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(n_docs + 1, np.int64))
    solid = ~_SPACE[data]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.logical_not(solid[:-1], out=fresh[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    fresh[inner] = True
    start = np.flatnonzero(solid & fresh)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[inner - 1] = True
    end = np.flatnonzero(solid & last) + 1
    up, down = _tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    return Words(start, end, value, np.searchsorted(start, offsets))


def grams(value: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (k up to 64); runs may cross documents, callers cut them."""
    m = len(value) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += value[j : j + m] * _MULT[j]
    return mix(out)


def long_grams(value: np.ndarray, k: int) -> np.ndarray:
    """As :func:`grams`, by prefix sums, for long runs."""
    n = len(value)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(value * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def whole(value: np.ndarray) -> np.uint64:
    """Hash of a short sequence with its length."""
    total = np.add.reduce(value * _MULT[: len(value)], keepdims=True)
    return mix(total + _MULT[63:] * np.uint64(len(value)))[0]


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct ``k``-word shingles; one with fewer words is one shingle, one without words none."""
    g = grams(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield np.array([whole(w.hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (n + 1 values)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
