"""Hashes of the words of many texts at once, in NumPy over their UTF-8 bytes.

A word's hash is a difference of running polynomial sums, so no loop runs over words. Texts come as Arrow string
arrays and are taken in slices of bounded size; only a single text may be larger than a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P, _P_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive slices; null texts are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes for which the 256-entry table inside holds; runs end with a row."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    on = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = on.copy()
    start[1:] &= ~on[:-1] | first[1:-1]
    end = on.copy()
    end[:-1] &= ~on[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, of the bytes as the 256-entry table maps them."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((data if table is None else table[data]).astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def joined(hashes: np.ndarray, rows: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each position, a hash of the items at position + step for each of steps (ascending, from 0), and its row.

    Only where all of them are in one row.
    """
    far = steps[-1]
    n = max(0, len(hashes) - far)
    same = rows[:n] == rows[far : far + n]
    total, factor = np.zeros(n, np.uint64), 1
    for step in steps:
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        total += hashes[step : step + n] * np.uint64(factor)
    return mix(total + np.uint64(far))[same], rows[:n][same]
