"""Vectorised byte kernels shared by the Python-style operators.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once: a text column becomes one
byte array with the bounds of each row, and words, shingles and windows become 64-bit hashes by
differences of one running sum, so the cost for each byte doesn't depend on the window's length.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once. Bounds the kernels' memory to some 40 times as much.
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n + 1, base, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


class Spans:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self._inverse = _powers(1 << max(21, int(n).bit_length()))
        self._sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE_VALUES[data] * power[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix64(raw + (end - start).astype(U64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of each range of ``width`` bytes, by its start."""
        n = len(self._sums) - 1
        if n < width:
            return np.empty(0, dtype=U64)
        return mix64((self._sums[width:] - self._sums[: n - width + 1]) * self._inverse[: n - width + 1] + U64(width))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row starts and ends (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    start, end = bounds[:-1], bounds[1:]
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, start)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), start, end


def blocks(start: np.ndarray, end: np.ndarray, most: int = BLOCK_BYTES):
    """Runs (first row, last row + 1) of about ``most`` bytes; a longer row comes alone."""
    size, first = end - start, 0
    while first < len(start):
        total = np.cumsum(size[first : first + 65536])
        last = first + max(1, int(np.searchsorted(total, most, side="right")))
        yield first, min(last, len(start))
        first = last


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges one after another, and the bounds of each in the result (one more than ranges)."""
    size = end - start
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    if len(start) and np.array_equal(start[1:], end[:-1]):
        return data[start[0] : end[-1]], bounds
    return data[ragged(start, size)], bounds


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same for each further range."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)


#: Bytes of words: digits, letters and everything beyond ASCII, after A-Z became a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows of a buffer, and the row bounds among the words."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero((here & (~before | cut))[:-1])
    end = np.flatnonzero(before & (~here | cut))
    return Spans(data).hash(start, end), np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a row; a shorter row that has words is one run."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out_bounds[1:])
    at = ragged(bounds[:-1], count)
    take = np.repeat(np.minimum(n, width), count)
    total = np.zeros(len(at), U64)
    for k in range(width):
        use = take > k
        if use.all():
            total = mix64(total + hashes[at + k] * U64(_BASE))
        else:
            total[use] = mix64(total[use] + hashes[at[use] + k] * U64(_BASE))
    return total, out_bounds


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def raw_size(head: bytes) -> int:
    """Bytes that a packed value unpacks to, from its first eight bytes."""
    return int.from_bytes(head, "little")


def trim() -> None:
    """Give freed memory back to the system, where its allocator has a call for that: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out
