"""Vectorised word kernels over Arrow string columns.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``.  All hashes are 64-bit
and depend on the bytes of a word (and a seed) alone, so equal words hash alike in every
task.  Arrays are worked through in slices of about ``SLICE`` bytes, so the
memory of a task does not depend on the number of rows in an Arrow batch.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xC2B2AE3D27D4EB4F)
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def mix64(x):
    """A bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes;
    a longer text makes a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def find_words(data: np.ndarray, off: np.ndarray):
    """(start, end, first): byte ranges of the words, and for each row the index
    of its first word (one more entry than rows)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1] | edge[1:n]
    e[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(s)
    return start, np.flatnonzero(e) + 1, np.searchsorted(start, off)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def word_hashes(data, start, end, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word.  Blocks of eight bytes (the last one filled up with
    zeros) are scrambled, each together with its place in the word and the seed, and
    added up; the sum and the length are scrambled again.  No step is linear in the
    bytes, so words that are built from the same parts do not meet by their structure."""
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    base = mix64(np.array([seed], np.uint64) * _STEP + _BASE)[0]
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        at, size = start[i:j] - start[i], end[i:j] - start[i:j]
        part = np.concatenate([data[start[i]:end[j - 1]], np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))          # eight bytes from each place on
        left = np.minimum(size, 8).astype(np.uint64)
        block = eight[at] & (_ALL >> (_U(64) - _U(8) * left))
        total = mix64(block ^ base)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8                                   # blocks after the first
            which = np.repeat(long, more)
            k = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
            left = np.minimum(size[which] - 8 * k, 8).astype(np.uint64)
            block = eight[at[which] + 8 * k] & (_ALL >> (_U(64) - _U(8) * left))
            block = mix64(block ^ mix64(base + k.astype(np.uint64) * _STEP))
            total[long] += np.add.reduceat(block, np.cumsum(more) - more)
        out[i:j] = mix64(total + size.astype(np.uint64) * _BASE)
        i = j
    return out


def gathered(data, start, end) -> pa.Array:
    """The words (none empty, in order) as an Arrow array of binary values."""
    size = end - start
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    off = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(size), [
        None, pa.py_buffer(off), pa.py_buffer(data[np.cumsum(edge[:-1], dtype=np.int8) > 0])])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (len(h) - k + 1 values, not
    regarding document ends): built from halves, log2(k) passes."""
    def run(k):
        if k == 1:
            return h
        if k % 2:
            low = run(k - 1)
            m = len(h) - k + 1
            return low[:m] * _STEP + h[k - 1:k - 1 + m]
        half = run(k // 2)
        m = len(h) - k + 1
        factor = _U(pow(int(_STEP), k // 2, 1 << 64))
        return half[:m] * factor + half[k // 2:k // 2 + m]

    if len(h) < k:
        return np.zeros(0, np.uint64)
    return mix64(run(k))


def whole(h: np.ndarray) -> int:
    """Hash of a whole (short) word sequence; distinct from the window hashes."""
    x = len(h)
    for v in h.tolist():
        x = (x * int(_STEP) + v) & 0xFFFFFFFFFFFFFFFF
    return int(mix64(_U(x) ^ _BASE)[0])


def release() -> None:
    """Give memory that a finished task has freed back to the machine (workers live on)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):             # a C library without it
        pass
