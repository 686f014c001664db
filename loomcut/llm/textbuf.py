"""Vectorised scanning of Arrow text columns.

An Arrow string column is one UTF-8 buffer and an offset array, so words can
be found and hashed with numpy over the whole buffer, without one Python
object per word.  Words are the runs ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; the temporaries are about 30 times that.
SLICE_BYTES = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Places in a word whose keys are kept; those further on are computed anew.
_KEPT = 1 << 20
_keys = np.zeros(0, np.uint64)


def _place_keys(at: np.ndarray, most: int) -> np.ndarray:
    """A pseudorandom odd number for every place in a word; ``most`` is above all of ``at``."""
    global _keys
    make = lambda x: mix(x.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    if most > _KEPT:
        return make(at)
    if _keys.size < most:
        _keys = make(np.arange(max(256, 1 << (most - 1).bit_length())))
    return _keys[at]


def lean(run: Callable) -> Callable:
    """``run`` over batches, giving freed memory back to the system after each of them."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                trim()

        yield from run(each())
        trim()

    return wrapped


def trim() -> None:
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    offs = offs[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, offs.size - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of consecutive rows: byte ranges in ``buf`` and the row of each."""

    buf: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return self.offs.size - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes in ``member`` (by default: not white space) within each row."""
    n = buf.size
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(buf, offs, z, z, z)
    inside = (member if member is not None else ~WS)[buf]
    first = offs[:-1][offs[:-1] < n]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[first] = inside[first]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    last = first[first > 0] - 1
    edge[last] = inside[last]
    end = np.flatnonzero(edge) + 1
    return Words(buf, offs, start, end, np.searchsorted(offs, start, side="right") - 1)


def hashes(w: Words, lower: bool = False, most: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hash of every word: its bytes times a pseudorandom number for their place, summed modulo 2**64, then mixed.

    It depends on the word's bytes alone, so it agrees between tasks and runs.
    The numbers follow no rule that words could: with powers of one base, words
    that swap two halves over and over hash alike whatever the base.
    """
    value = (LOWER if lower else np.arange(256)).astype(np.uint64) + np.uint64(1)
    out = np.zeros(w.start.size, np.uint64)
    i = 0
    while i < w.start.size:
        j = int(np.searchsorted(w.end, w.start[i] + most, side="right"))
        if j <= i:  # one word longer than that, part after part
            for a in range(int(w.start[i]), int(w.end[i]), most):
                b = min(a + most, int(w.end[i]))
                at = np.arange(a, b) - int(w.start[i])
                with np.errstate(over="ignore"):
                    out[i] += (value[w.buf[a:b]] * _place_keys(at, int(at[-1]) + 1)).sum(dtype=np.uint64)
            i += 1
            continue
        s, e = w.start[i:j], w.end[i:j]
        length = e - s
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        byte = w.buf[at + np.repeat(s, length)]
        with np.errstate(over="ignore"):
            v = value[byte] * _place_keys(at, int(length.max()))
            out[i:j] = np.add.reduceat(v, np.cumsum(length) - length)
        i = j
    return mix(out)


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each half-open range of ``offs``, which cover them all."""
    if values.dtype == bool:
        values = values.astype(np.int64)
    out = np.zeros(offs.size - 1, values.dtype)
    some = offs[1:] > offs[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offs[:-1][some])
    return out
