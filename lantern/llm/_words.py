"""Vectorised words and rolling hashes of whole texts, for use inside Arrow tasks.

Texts are UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D; those bytes never occur inside a
multi-byte character. Hashes are 64-bit polynomials over the bytes (or over word hashes), taken as differences of
prefix sums and then mixed, so that one pass over a chunk costs a few array operations a byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of text that a task takes from an Arrow batch at once.
PIECE_BYTES = 4 << 20
#: Powers kept for later chunks; more are computed anew for each longer text.
KEPT_POWERS = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = (np.ones(1, U), np.ones(1, U))


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives its memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        tables = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, U)
            a[0] = 1
            tables.append(np.cumprod(a, dtype=U))
        if size > KEPT_POWERS:
            return tuple(tables)
        _powers = tuple(tables)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever it stands."""
    h = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some whole documents; words are numbered over the chunk."""

    docs: list[int]  # positions in the batch
    raw: np.ndarray  # bytes of all texts, with a line feed after each
    data: np.ndarray  # the same, lower-cased if asked for
    base: np.ndarray  # first byte of each document
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each document, and the number of words
    doc: np.ndarray  # document of each word, from 0 in the chunk
    hash: np.ndarray  # hash of each word

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``k`` words inside one document, and their hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, span_hash(prefix_sums(self.hash), at, at + k)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about PIECE_BYTES of text in ``column``, so that few texts are held as objects."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64
        edge = np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(size)]):
            if lo < hi:
                yield batch.slice(lo, hi - lo)


def chunked(texts: list[bytes]) -> Iterator[list[int]]:
    own, size = [], 0
    for i, x in enumerate(texts):
        if own and size + len(x) > CHUNK_BYTES:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(x) + 1
    if own:
        yield own


def layout(texts: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """One array of the texts, each followed by a line feed, and where each begins."""
    own = [texts[i] for i in docs]
    raw = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
    base = np.zeros(len(own), np.int64)
    np.cumsum([len(x) + 1 for x in own[:-1]], out=base[1:])
    return raw, base


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    if len(inside) and inside[-1]:
        change = np.concatenate([change, [len(inside)]])
    return change[::2], change[1::2]


def assemble(docs, raw, data, base, start, end) -> Chunk:
    sums = prefix_sums(_BYTE_VALUE[data])
    first = np.append(np.searchsorted(start, base), len(start))
    doc = np.repeat(np.arange(len(base)), np.diff(first))
    return Chunk(docs, raw, data, base, start, end, first, doc, span_hash(sums, start, end))


def word_chunks(texts: list[bytes], lower: bool) -> Iterator[Chunk]:
    for docs in chunked(texts):
        raw, base = layout(texts, docs)
        data = LOWER[raw] if lower else raw
        start, end = edges(~SPACE[data])
        yield assemble(docs, raw, data, base, start, end)
