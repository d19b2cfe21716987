"""Monotone integers in near-minimal space: Elias-Fano with a directory for select.

``n`` values up to ``u`` take about ``2 + log2(u / n)`` bits each. The low bits of all values are packed; the high parts
are a bitmap in which the k-th one stands at bit ``high + k``. A directory of 32-bit counts, one to BLOCK_BYTES of the
bitmap, finds the k-th one without reading the bitmap from its start; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IIIB")
BLOCK_BYTES = 64
#: Values that are selected at once.
_SLICE = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: Place of the r-th one in each byte; where there are fewer, any place.
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """``values``: integers from 0, none less than the one before; ``n`` below 2**32. No values: an empty structure."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (values[0] < 0 or (np.diff(values) < 0).any()):
        raise ValueError("the values must be from 0 and must not fall")
    most = int(values[-1]) if n else 0
    width = max(0, (most // n).bit_length() - 1) if n else 0
    low = (values[:, None] >> np.arange(width)) & 1
    high = np.zeros(-(-((most >> width) + n + 1) // (8 * BLOCK_BYTES)) * 8 * BLOCK_BYTES, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    counts = high.reshape(-1, 8 * BLOCK_BYTES).sum(axis=1)
    before = (np.cumsum(counts) - counts).astype("<u4").tobytes()
    packed, bitmap = _pack(low.astype(np.uint8).ravel()), _pack(high)
    return _HEAD.pack(n, len(packed), len(bitmap), width) + packed + bitmap + before


class EliasFano:
    """Random access to what ``encode`` wrote."""

    def __init__(self, data: bytes):
        self.n, low, high, self.width = _HEAD.unpack_from(data)
        at = _HEAD.size
        self._low = np.frombuffer(data, np.uint8, low, at)
        self._high = np.frombuffer(data, np.uint8, high, at + low).reshape(-1, BLOCK_BYTES)
        self._before = np.frombuffer(data, "<u4", high // BLOCK_BYTES, at + low + high)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The values at places ``k``, from 0."""
        k = np.asarray(k, np.int64)
        if len(k) and (k.min() < 0 or k.max() >= self.n):
            raise IndexError("no such value")
        return np.concatenate([self._select(k[i : i + _SLICE]) for i in range(0, len(k), _SLICE)] or [np.zeros(0, np.int64)])

    def _select(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self._before, k, side="right") - 1
        inside = k - self._before[block]
        sums = np.cumsum(_ONES[self._high[block]], axis=1)
        byte = (sums <= inside[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        inside -= np.where(byte > 0, sums[rows, byte - 1], 0)
        place = 8 * (block * BLOCK_BYTES + byte) + _PLACE[self._high[block, byte], inside]
        if not self.width:
            return place - k
        bit = k[:, None] * self.width + np.arange(self.width)
        low = ((self._low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.width)
        return ((place - k) << self.width) | low.sum(axis=1)

    def all(self) -> np.ndarray:
        return self.select(np.arange(self.n))
