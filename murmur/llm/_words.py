"""Vectorised word hashing over Arrow string columns.

Every function works on the raw UTF-8 buffers of an Arrow column with numpy, so no Python
object is made per row or per word.  A word is a maximal run of bytes for which a 256-entry
table is true; rows never share a word.  Hashes are 64 bits wide: the sum over a word's bytes
of table[byte] * weight[position] with pseudo-random 64-bit entries, then mixed.  Null texts
count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text hashed at a time; bounds the temporaries to some 30 MB.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise over uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: Tables of two hash functions of bytes that share nothing.
_BYTE = [_random(256, 11) | U(1), _random(256, 12) | U(1)]
_weights = [_random(4096, 23) | U(1), _random(4096, 24) | U(1)]


def _weight(n: int, which: int) -> np.ndarray:
    if n > len(_weights[which]):
        _weights[which] = _random(2 * n, 23 + which) | U(1)
    return _weights[which]


def byte_table(space: bool = True) -> np.ndarray:
    """True for the bytes of words split at ASCII white space: ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


WORD = byte_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, from 0."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(text: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the words, block by block in order."""
    n, at = len(text), 0
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:  # a block ends before a byte outside words, or where a row begins
            step = text[to : to + BLOCK]
            gaps = np.flatnonzero(~table[step])
            row = rows[np.searchsorted(rows, to)] if len(rows) and rows[-1] >= to else n
            cut = to + int(gaps[0]) if len(gaps) else to + len(step)
            if min(cut, row) < to + len(step) or cut >= n:
                to = int(min(cut, row))
                break
            to += len(step)
        m = table[text[at:to]]
        first = m.copy()
        first[1:] &= ~m[:-1]
        last = m.copy()
        last[:-1] &= ~m[1:]
        inside = rows[np.searchsorted(rows, at) : np.searchsorted(rows, to)] - at
        first[inside] = m[inside]
        before = inside[inside > 0] - 1
        last[before] = m[before]
        yield np.flatnonzero(first) + at, np.flatnonzero(last) + at + 1
        at = to


def hashes(text: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = LOWER, table: np.ndarray = WORD, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, and the row offsets among words.

    fold maps bytes before hashing (LOWER lower-cases A-Z; None leaves them); which, 0 or 1, is the hash function."""
    parts, starts = [], []
    for s, e in spans(text, offsets, table):
        if not len(s):
            continue
        size = e - s
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(before, size)
        codes = text[np.repeat(s, size) + at]
        if fold is not None:
            codes = fold[codes]
        value = _BYTE[which][codes] * _weight(int(size.max()), which)[at]
        parts.append(mix(np.add.reduceat(value, before) + size.astype(U)))
        starts.append(s)
    if not parts:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k consecutive entries; len(h) - k + 1 of them, none if h is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    weight = _random(k, 1000 + seed) | U(1)
    out = h[:n] * weight[0]
    for j in range(1, k):
        out += h[j : j + n] * weight[j]
    return mix(out)


def give_back() -> None:
    """Return what numpy and Arrow have let go of to the system: a worker that waits keeps some 60 MB otherwise, and an executor has
    several."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, which bounds what a task holds at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
        give_back()


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits, for Spark's long."""
    return x.view(np.int64)
