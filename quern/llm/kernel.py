"""Vectorised text primitives on Arrow buffers.

Operators of this subpackage read whole Arrow string columns as one byte
buffer with document offsets, so that words, hashes and shingles come from
numpy passes without a Python object per document or word.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds at a time (a longer document is a pass of its own).
PASS_BYTES = 1 << 20

_U = np.uint64


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it is one whose allocator can be told to give memory back; told so once."""
    try:
        c = ctypes.CDLL(ctypes.util.find_library("c"))
        c.mallopt(-3, 1 << 18)  # arrays of this size have their own pages, which go back when they go
        c.mallopt(-1, 1 << 20)
        return c if hasattr(c, "malloc_trim") else None
    except (OSError, TypeError, AttributeError):
        return None


def frugal() -> None:
    """Gives memory that arrays no longer use back to the system, now and from now on; elsewhere than with glibc nothing changes."""
    if (c := _libc()) is not None:
        c.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def random_table(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudorandom 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(0x9E3779B9)) * _U(0x9E3779B97F4A7C15))


_BYTE = random_table(7, 256)
_Q, _QINV = _U(0xD6E8FEB86659FD93), _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < PASS_BYTES + 1:
        with np.errstate(over="ignore"):
            for k, q in enumerate((_Q, _QINV)):
                a = np.full(PASS_BYTES + 1, q, np.uint64)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1, from 0) and null mask of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    o = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0], null


def passes(offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a document's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place. Spans are in order of their starts; some are hashed at a time, and a long one by parts."""
    out = np.empty(len(starts), np.uint64)
    q, qinv = _power_tables()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = int(starts[i])
            if ends[i] - base > PASS_BYTES:
                out[i] = _U(0)
                for at in range(base, int(ends[i]), PASS_BYTES):
                    part = _BYTE[data[at : min(at + PASS_BYTES, int(ends[i]))]]
                    out[i] += (part * q[: len(part)]).sum(dtype=np.uint64) * _U(pow(int(_Q), at - base, 1 << 64))
                i += 1
                continue
            j = i + int(np.searchsorted(starts[i:], base + PASS_BYTES // 2, side="right"))
            over = np.flatnonzero(ends[i:j] - base > PASS_BYTES)
            j = i + int(over[0]) if len(over) else j
            own = data[base : int(ends[i:j].max())]
            c = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_BYTE[own] * q[: len(own)], out=c[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (c[e] - c[s]) * qinv[s]
            i = j
        return mix64(out + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (ASCII) bytes, starts and ends of words, first word of each document (n + 1).

    A word is a run of ASCII letters and digits and of all other characters
    outside ASCII; everything else separates.
    """
    low = _LOWER[data]
    starts, ends = spans(_WORD[low], offsets)
    return low, starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words and the first of each document (n + 1).

    A document of fewer than ``n`` words has one shingle of all it has.
    """
    with np.errstate(over="ignore"):
        count = np.diff(first)
        out_n = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        out_first = np.concatenate([[0], np.cumsum(out_n)]).astype(np.int64)
        doc = np.repeat(np.arange(len(count)), out_n)
        at = first[:-1][doc] + np.arange(out_first[-1]) - out_first[:-1][doc]
        left = count[doc]
        padded = np.concatenate([h, np.zeros(n, np.uint64)])
        acc = padded[at].copy()
        for k in range(1, n):
            nxt = padded[at + k]
            nxt[left <= k] = 0
            acc = acc * _U(0x9FB21C651E98DF25) + nxt
        return mix64(acc), out_first
