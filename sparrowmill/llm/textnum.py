"""Vectorised work on Arrow text columns: words, shingle hashes and rolling hashes as numpy arrays.

Every function takes whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: glibc's; other C libraries have none.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: XXH64's five primes (fixed values of that hash).
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Bytes that end a word: space and \t \n \v \f \r.
DELIM = np.zeros(256, bool)
DELIM[[0x20, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows of at most `most` bytes of text, or of one row: bounds the memory of what follows."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Gives memory that is free back to the system: a worker lives on, and what it has freed would count beside the next task's."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of each row: `doc`, `start`, `end` by word; `first`, `count` by row.

    `joined` holds the words of a row with one space between two, `at` and `to` are the words' places in it.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        buf, off = text_bytes(column)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
        n, rows = len(buf), len(off) - 1
        word = ~DELIM[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            before &= ~edge[:n]
            after = np.append(word[1:], False) & ~edge[1:]
            self.start = np.flatnonzero(word & ~before)
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.buf, self.off, self.rows = buf, off, rows
        self.doc = np.searchsorted(off[1:], self.start, side="right") if n else np.zeros(0, np.int64)
        self.count = np.bincount(self.doc, minlength=rows)
        self.first = np.cumsum(self.count) - self.count
        keep = word | (~word & before) if n else word
        self.joined = np.append(np.where(word, buf, 32)[keep].astype(np.uint8), np.zeros(8, np.uint8))
        self.at = np.cumsum(keep)[self.start] - 1 if n else self.start
        self.to = self.at + (self.end - self.start)

    def values(self) -> pa.BinaryArray:
        """All words, one after the other."""
        lens = self.end - self.start
        data = self.buf[~DELIM[self.buf]] if len(self.buf) else self.buf
        off = np.zeros(len(lens) + 1, np.int32)
        np.cumsum(lens, out=off[1:])
        return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, length) in `joined` of each row's shingles of `width` words; fewer words: one of them all."""
        i = np.arange(len(self.doc))
        last = (self.first + self.count - 1)[self.doc]
        ok = (i + width - 1 <= last) | (i == self.first[self.doc])
        i, last = i[ok], last[ok]
        start = self.at[i]
        return self.doc[i], start, self.to[np.minimum(i + width - 1, last)] - start


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start + length] for each pair. `buf` has 8 bytes more than its strings need."""
    with np.errstate(over="ignore"):
        seed = U(seed)
        lanes = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (max(len(buf) - 7, 0), 8), (1, 1))

        def lane(at: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(lanes[at]).view("<u8")[:, 0]

        start, length = start.astype(np.int64), length.astype(np.int64)
        h = np.full(len(start), seed + P5, U)
        at, left = start.copy(), length.copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            v = [np.full(len(long), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            todo = np.arange(len(long))
            while len(todo):
                rows = long[todo]
                for j in range(4):
                    v[j][todo] = _rot(v[j][todo] + lane(at[rows] + 8 * j) * P2, 31) * P1
                at[rows] += 32
                left[rows] -= 32
                todo = todo[left[rows] >= 32]
            x = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for j in range(4):
                x = (x ^ (_rot(v[j] * P2, 31) * P1)) * P1 + P4
            h[long] = x
        h += length.astype(U)
        for _ in range(3):
            rows = np.flatnonzero(left >= 8)
            if not len(rows):
                break
            h[rows] = _rot(h[rows] ^ (_rot(lane(at[rows]) * P2, 31) * P1), 27) * P1 + P4
            at[rows] += 8
            left[rows] -= 8
        rows = np.flatnonzero(left >= 4)
        if len(rows):
            h[rows] = _rot(h[rows] ^ ((lane(at[rows]) & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[rows] += 4
            left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left >= 1)
            if not len(rows):
                break
            h[rows] = _rot(h[rows] ^ (buf[at[rows]].astype(U) * P5), 11) * P1
            at[rows] += 1
            left[rows] -= 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
        return h


def _table() -> np.ndarray:
    """256 odd-looking 64-bit values by a rule: the mixed bytes 0..255."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BASE = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE = _table()
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by worker."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        p = np.full(1 << max(16, int(n - 1).bit_length()), base, U)
        p[0] = 1
        with np.errstate(over="ignore"):
            known = _powers[int(base)] = np.multiply.accumulate(p)
    return known[:n]


class Rolling:
    """Hashes of any substring in constant time: a polynomial modulo 2 ** 64 over mixed bytes (or values)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            v = BYTE[values] if values.dtype == np.uint8 else values
            np.cumsum(v * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U) * P3)

    def windows(self, k: int) -> np.ndarray:
        """The hash of each window of k."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: len(self.prefix) - k] + U(k) * P3)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) by doubling."""
    m, s = x, 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (width - s)], m[width - s :]) if width > s else m


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are the least of some run of `width` (ties: all of them): what a run picks depends on its values alone."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    m = sliding_min(h, width)
    pad = np.zeros(width - 1, U)
    top = ~sliding_min(~np.concatenate([pad, m, pad]), width)
    return np.flatnonzero(h == top[: len(h)])
