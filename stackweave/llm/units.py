"""Texts cut into units that a tokenizer treats independently, each distinct unit encoded once for a worker.

A unit begins at white space that follows a character that is surely none. Natural text repeats most units, so
that the encoder sees each one a few times only; the ids of a text are gathered from those of its units.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import text as X

#: Units that a worker keeps the ids of. Beyond it the worker starts afresh; results don't depend on it.
KEPT = 600_000


def starts(buf: np.ndarray, at: np.ndarray, only_space: bool = False) -> np.ndarray:
    """Offsets at which units begin: each document's start and the cuts.

    A cut needs a character before it that no definition of white space includes: printable ASCII, or two bytes
    from U+00C0 on. Without ``only_space`` all ASCII white space cuts.
    """
    n = len(buf)
    first = at[:-1][np.diff(at) > 0]
    if n < 2:
        return first
    here = (buf[1:] == 32) if only_space else ~X.NOT_SPACE[buf[1:]]
    before = buf[:-1]
    safe = (before > 32) & (before < 127)
    if only_space:
        safe = before != 32
    else:
        two = np.zeros(n - 1, bool)
        two[1:] = (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF)
        safe |= (before >= 0x80) & two
    cut = np.zeros(n, bool)
    cut[1:] = here & safe
    cut[first] = True
    return np.flatnonzero(cut)


class Encoded:
    """ids of units by their bytes. encode(list of units) gives (flat ids, length of each)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        self.encode, self.kept = encode, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def lookup(self, units: list[bytes]) -> np.ndarray:
        get = self.index.get
        found = np.array([get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(found < 0)
        if len(self.index) + len(new) > self.kept and len(self.index):
            self.clear()
            found[:] = -1
            new = np.arange(len(units))
        if len(new):
            fresh = [units[i] for i in new.tolist()]
            flat, length = self.encode(fresh)
            n = len(self.index)
            self._room("flat", self.used + len(flat))
            self._room("start", n + len(fresh))
            self._room("length", n + len(fresh))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[n : n + len(fresh)] = self.used + np.cumsum(length) - length
            self.length[n : n + len(fresh)] = length
            self.used += len(flat)
            self.index.update(zip(fresh, range(n, n + len(fresh))))
            found[new] = np.arange(n, n + len(fresh))
        return found

    def documents(self, buf: np.ndarray, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, end of each) from units that begin at ``begin``."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        offsets = np.append(begin, len(buf)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = column.dictionary_encode()
        entry = self.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        length = self.length[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[X.ragged(self.start[entry], length)], total[np.searchsorted(begin, at[1:])]
