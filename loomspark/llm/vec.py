"""Vectorised helpers over the UTF-8 buffers that Arrow hands to a worker.

Everything works on whole texts: a batch is cut into pieces of rows, never a
row into a prefix, so memory follows the piece size (or the longest single
text) and results do not depend on where the cuts fall.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def lean(run):
    """The function of a mapInArrow that gives freed memory back when a task ends; workers are kept for later tasks and would hold on to it."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return inner


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length n + 1, starting at 0) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES):
    """Slices of whole rows of about `most` text bytes; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inverse):
        p = np.empty(size, np.uint64)
        p[0], done, step = 1, 1, base
        while done < size:
            n = min(done, size - done)
            p[done : done + n] = p[:n] * np.uint64(step)
            done += n
            step = step * step & _MASK
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span data[start:end]; equal spans have equal hashes wherever they lie."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = 1 << max(16, int(len(data) - 1).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def ragged(flat: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[offset[i] : offset[i] + length[i]] for all i, one after the other."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.repeat(offset - (ends - length), length) + np.arange(total)]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of ASCII letters or digits and of non-ASCII characters but for punctuation (U+0080 to U+00BF, U+2000 to U+206F, U+3000 to U+303F)."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    is_word = _WORD[data]
    mark = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    if len(mark):
        second = data[np.minimum(mark + 1, len(data) - 1)]
        wide = mark[((data[mark] == 0xE2) & ((second == 0x80) | ((second == 0x81) & (data[np.minimum(mark + 2, len(data) - 1)] < 0xB0)))) | ((data[mark] == 0xE3) & (second == 0x80))]
        is_word[wide] = is_word[wide + 1] = is_word[wide + 2] = False
        narrow = mark[data[mark] == 0xC2]
        is_word[narrow] = is_word[narrow + 1] = False
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= is_word[cut]
    last[cut - 1] |= is_word[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


class Memo:
    """Direct-mapped cache of an integer function, looked up for whole arrays; never grows."""

    def __init__(self, compute, bits: int = 20):
        self.compute, self.shift = compute, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_P)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        miss = self.keys[slot] != keys
        if miss.any():
            wanted = keys[miss]
            u = np.unique(wanted)
            v = self.compute(u)
            s = self._slot(u)
            self.keys[s], self.values[s] = u, v
            # two keys of u may share a slot: the last one written wins both arrays
            out[miss] = v[np.searchsorted(u, wanted)]
        return out
