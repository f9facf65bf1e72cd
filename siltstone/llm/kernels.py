"""Numpy kernels over Arrow string buffers, shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at once; arrays of eight bytes a character stay near the cache.
BLOCK = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + (BLOCK >> 2))
        for base in (_BASE, _INV):
            p = np.full(m, base, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf, off


def blocks(buf: np.ndarray, off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) for runs of whole documents of about ``size`` bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def ids_of(col) -> tuple[np.ndarray, np.ndarray]:
    """(doc ids as int64, which are not null)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    there = col.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.cast(col, pa.int64()), 0).to_numpy(zero_copy_only=False), there


def _table(chars: str, high: bool) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    t[128:] = high
    return t


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Word bytes: ASCII letters and digits, and every byte of a longer character.
WORD = _table(_ALNUM, True)
#: Bytes of tokens between white space.
SOLID = ~_table(" \t\n\r\x0b\x0c", False)
#: ASCII letters made small, and 1 added so that no byte is zero.
LOWER = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint16)
EXACT = np.arange(1, 257, dtype=np.uint16)


def runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, run offsets by document) of the maximal runs of the table's bytes inside documents."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[off] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span comes in constant time."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(table[buf].astype(U64) * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal bytes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD, fold: np.ndarray = LOWER):
    """(hashes, starts, ends, word offsets by document)."""
    s, e, woff = runs(buf, off, table)
    return span_hash(prefix_hash(buf, fold), s, e), s, e, woff


def grams(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a document; a document of fewer words has one run, of them all."""
    n = np.diff(woff)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    goff = np.concatenate([[0], np.cumsum(m)])
    if not goff[-1]:
        return np.empty(0, U64), goff
    at = np.arange(goff[-1]) + np.repeat(woff[:-1] - goff[:-1], m)
    end = np.repeat(woff[1:], m)
    out = np.zeros(len(at), U64)
    for j in range(k):
        c = U64((0xD6E8FEB86659FD93 * (2 * j + 1) ** 3 | 1) % (1 << 64))
        i = at + j
        if j and (short := i >= end).any():
            part = h[np.minimum(i, len(h) - 1)] * c
            part[short] = 0
            out += part
        else:
            out += h[i] * c
    return mix(out), goff


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, which shouldn't find it held by those before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """run, a mapper of Arrow batches, that gives memory back when its partition is done."""

    def mapper(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapper


def binary_rows(data: np.ndarray, width: int, n: int) -> pa.Array:
    """A binary array of n values of one width."""
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def list_rows(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array over flat values."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32()), pa.array(values, kind))
