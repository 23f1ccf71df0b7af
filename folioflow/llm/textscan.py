"""Vectorised text scanning over Arrow buffers: words, word hashes and offsets without a Python object per word.

Texts are handled as the UTF-8 bytes that Arrow holds. Word classes here are such that every byte of a
multi-byte character is a word byte, so byte-wise and character-wise words are the same.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19
U64 = np.uint64

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ before or after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
SOLID = np.ones(256, bool)
SOLID[0x20] = False
SOLID[0x09:0x0E] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE = seeded(256, 11)
BYTE_LOWER = BYTE[LOWER]
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hash's powers and inverse powers, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 1024)
        for k, p in enumerate((_P, _INV)):
            x = np.full(size, p, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit symbols, by one running sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * p[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k symbols in a row."""
        m = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:m]) * self.inverse[:m])


def give_back() -> None:
    """What was freed goes back to the system: a Python worker stays for the next stage, and would hold it beside what that stage needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(column: pa.Array, limit: int = GROUP_BYTES):
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about limit bytes; a longer text is a run of its own."""
    data, at = flat(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offset of each text's first word among them (one more than texts)."""
    inside = table[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    held = at[:-1] < at[1:]
    edge = at[:-1][held]
    first[edge] = inside[edge]
    edge = at[1:][held] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + GROUP_BYTES, "right")))
        base = starts[i]
        r = Rolling(table[data[base : ends[j - 1]]])
        out[i:j] = r.spans(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = np.asarray(starts)[full], np.asarray(counts)[full]
    if not len(starts):
        return np.zeros(0, np.int64)
    out[0] = starts[0]
    heads = np.cumsum(counts)[:-1]
    out[heads] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.r_[True, starts[1:] > reach[:-1]]
    return starts[head], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(starts) - 1]]


def alike(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x from a and y from b agree in size symbols, for each pair; compared symbol for symbol, in pieces. No size is 0."""
    out = np.ones(len(a), bool)
    edge = np.r_[0, np.cumsum(size)]
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + (1 << 20), "right")) - 1)
        s = size[i:j]
        out[i:j] = np.logical_and.reduceat(x[ragged(a[i:j], s)] == y[ragged(b[i:j], s)], edge[i:j] - edge[i])
        i = j
    return out
