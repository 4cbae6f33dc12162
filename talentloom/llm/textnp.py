"""Vectorised word and window hashing over the UTF-8 buffers of Arrow columns.

Everything here works on numpy arrays that view Arrow buffers; no Python string
is made per word. Hashes are 64-bit polynomial sums modulo 2**64 over random
byte weights, finished by an avalanche step, and do not depend on the offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BYTE_WEIGHT2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in BASES]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Offset-free polynomial hash of values[start:end] for each span."""
    up, down = _powers[family].get(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each (one row at least)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and word offsets by row."""
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        cut = offsets[:-1]
        before[cut[cut < len(inside)]] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:] - 1
        after[cut[cut >= 0]] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Word offsets by row, without any hash."""
    counts = [np.zeros(1, np.int64)]
    for i, j in chunks(offsets):
        counts.append(word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2][1:] + counts[-1][-1])
    return np.concatenate(counts)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, second: bool = False):
    """64-bit hashes of all words of all rows and word offsets by row; second: an independent hash too."""
    parts, more, counts = [], [], [np.zeros(1, np.int64)]
    for i, j in chunks(offsets):
        d = data[offsets[i] : offsets[j]]
        if lower:
            d = LOWER[d]
        starts, ends, by_row = word_spans(d, offsets[i : j + 1] - offsets[i])
        parts.append(span_sums(BYTE_WEIGHT[d], starts, ends, 0))
        if second:
            more.append(span_sums(BYTE_WEIGHT2[d], starts, ends, 1))
        counts.append(by_row[1:] + counts[-1][-1])
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    by_row = np.concatenate(counts)
    return (out, np.concatenate(more) if more else out, by_row) if second else (out, by_row)


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Small bytes of an integer array: deltas if sorted, bytes of like weight together, then zstd."""
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    shape = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(shape).tobytes())


def unpack(blob: bytes, dtype, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    out = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(out, dtype=dtype) if delta else out
