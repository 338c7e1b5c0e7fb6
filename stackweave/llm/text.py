"""Vectorised views of a column of texts, shared by the operators of this package.

A batch of texts is one byte array and the offsets of its documents. Null counts as the empty text. A word
never crosses a document's end. Everything here runs inside tasks, on pieces of bounded size (a single longer
text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
with np.errstate(over="ignore"):
    INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of words that white space \x20 \x09-\x0D separates.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: True for ASCII letters and digits and for all bytes of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and len + 1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of at most ``limit`` bytes of text (or one row), with bytes and offsets."""
    for batch in batches:
        buf, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no document's end lies within."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n; kept for the worker's next pieces."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, so that all bits of the result depend on all bits given."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def running(buf: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE ** place up to each place, from which spans_hash() takes differences."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=total[1:])
    return total


def spans_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), the same wherever a string stands; total is running()."""
    return mix((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True):
    """(starts, ends, hashes, first word of each document) of the runs of bytes for which ``inside`` holds."""
    start, end = edges(inside[buf], at)
    return start, end, spans_hash(running(LOWER[buf] if lower else buf), start, end), np.searchsorted(start, at)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; of all its words if it has fewer."""
    with np.errstate(over="ignore"):
        n = max(0, len(word) - k + 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = mix(total * np.uint64(3) + word[i : i + n] + np.uint64(i + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(total[a : b - k + 1])
            elif b > a:
                own = np.uint64(b - a)
                for i in range(a, b):
                    own = mix(np.array([own * np.uint64(3) + word[i] + np.uint64(i - a + 1)], np.uint64))[0]
                yield np.array([own], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices start[i], ..., start[i] + length[i] - 1, one i after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


def binary_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of flat[ends[i - 1]:ends[i]]."""
    at = np.concatenate([[0], ends]).astype(np.int64) * flat.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def list_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column: row i holds flat[ends[i - 1]:ends[i]]."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
