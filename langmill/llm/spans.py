"""Words, lines and substrings of whole text columns as numpy arrays.

A batch of texts is one byte buffer with offsets. Every substring gets a 64-bit fingerprint from two
prefix sums, so shingles, windows and contexts need no Python loop over characters. All functions look
at bytes; a code point is counted by its first byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes of text handled at once; one longer text is handled alone.
BLOCK = 2 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit integers."""
    x = (x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))).astype(_U, copy=False)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = [mix(np.arange(256, dtype=_U), salt) for salt in (11, 29)]
_power = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = (1 << (n - 2).bit_length()) + 1
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _power[name] = np.cumprod(steps, dtype=_U)
    return _power["up"][:n], _power["down"][:n]


def blocks(column: pa.Array, limit: int = BLOCK, kind: pa.DataType = pa.large_string()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts, or of bytes, into blocks: first row, end row, bytes, offsets (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"" if kind == pa.large_binary() else "", kind))
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Prints:
    """Fingerprints of any substrings of one buffer."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        self.up, down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_VALUES[kind][data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(_U))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes other than space and 0x09-0x0D; rows never join."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, rows_at(starts, offsets)


def rows_at(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets[:-1], positions, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First item and fingerprint of every ``n`` consecutive items of one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(len(first), dtype=_U)
    for k in range(n):
        out = mix(out * _U(_MULTIPLIER) + hashes[first + k])
    return first, out


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets by row of items sorted by row."""
    return np.searchsorted(row, np.arange(n + 1))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
