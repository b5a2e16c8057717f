"""Whole columns of text as flat byte arrays: words and their hashes without a Python loop.

A chunk of an Arrow column is one uint8 array plus row offsets. Words are runs of bytes
other than space and 0x09-0x0D; as those separators are ASCII, UTF-8 needs no decoding.
Hashes are 64-bit polynomials of a random value per byte, taken from one prefix sum.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes a chunk; a longer text is a chunk of its own

_rng = np.random.default_rng(20_240_117)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _rng.integers(1, 2**62, 1, dtype=np.uint64)[0] * np.uint64(4) + np.uint64(3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, flat[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row boundary."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; span_hash takes spans from them."""
    n = len(values)
    up, _ = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[values] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, lower-cased for A-Z, in text order."""
    starts, ends = runs(~SEPARATOR[data], offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return span_hash(prefix_sums(LOWER[data]), starts, ends), rows


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
