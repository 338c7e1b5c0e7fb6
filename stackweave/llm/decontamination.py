"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, A-Z in lower case. Each fixed mask keeps some positions of a window of words
and ignores the others, so that a hash of the kept words is the same although an ignored word was replaced. Hashes
of the documents' windows meet those of the benchmark's. Around each hit the item is laid over the document, word
by word without gaps, and the overlap is verified: the document is contaminated by the item if some window of
WINDOW words (the whole item if it is shorter) has at least NUM / DEN of them equal.

Null and empty texts are never contaminated; items without words contaminate nothing. For items
shorter than WINDOW, masks of the whole item are added for the replacements that no mask fits. A document that holds an
item several times has one row for it, with the overlap of most equal words (ties: the first). Repeated rows of a
doc_id have one row; a null doc_id or item_id is left out. Very long texts are sought through whole, and hits are
gathered a bounded number at a time, so that a text and an item that both repeat a word need no more memory than they
have diagonals. An empty table gives no rows. Further columns are not read; without_contaminated() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Kept (1) and ignored (0) positions. With every fifth word replaced some window still fits the first.
MASKS = ("111101111", "1101011", "11100111", "111111")
WINDOW, NUM, DEN = 13, 4, 5
#: Words of benchmark items that a worker holds at once. A larger benchmark is several groups, sought one after the other.
AT_ONCE = 2_000_000
#: Bytes of text that a worker gathers before it takes the next group, where there are several.
GATHERED = 32 << 20
FILTER_BITS = 23
#: Hits of a mask that are held at once.
HITS_AT_ONCE = 1 << 22
SCHEMA = "doc_id long, item_id long, start long, end long, n_words int, n_equal int"


def seeds(word: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of the windows that lie within one document."""
    n = max(0, len(word) - len(mask) + 1)
    doc_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + len(mask) <= doc_end[:n])
    kept = [i for i, c in enumerate(mask) if c == "1"]
    with np.errstate(over="ignore"):
        h = np.full(len(at), len(mask) * 131 + int(mask, 2), np.uint64)
        for i in kept:
            h = (h ^ word[at + i]) * X.BASE
            h ^= h >> np.uint64(29)
    return h, at


@cache
def whole_masks(n: int) -> tuple[str, ...]:
    """Masks of a whole item of n words, one for each placement of replaced words that fits no window of MASKS."""
    if not 0 < n < WINDOW:
        return ()
    fits = lambda mask, s, place: all(mask[p - s] == "0" for p in place if s <= p < s + len(mask))
    places = combinations(range(n), n * (DEN - NUM) // DEN)
    return tuple("".join("01"[i not in place] for i in range(n)) for place in places if not any(fits(m, s, place) for m in MASKS for s in range(n - len(m) + 1)))


@dataclass
class Items:
    """Items with their words, and the sorted seeds of all of them."""

    ids: np.ndarray
    word: np.ndarray
    first: np.ndarray
    masks: list[str]
    seed: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray


def items_of(ids: list[int], texts: list[str]) -> Items:
    buf, at = X.utf8(pa.array(texts, pa.string()))
    _, _, word, first = X.words(buf, at, X.LETTER)
    length = np.diff(first)
    whole = [m for n in sorted({int(n) for n in length}) for m in whole_masks(n)]
    masks = [*MASKS, *whole]
    got = []
    for mask in masks:
        h, p = seeds(word, first, mask)
        owner = np.searchsorted(first, p, "right") - 1
        if mask in whole:  # only for items of just this length
            use = length[owner] == len(mask)
            h, p, owner = h[use], p[use], owner[use]
        got.append((h, owner, p - first[owner]))
    seed, item, offset = (np.concatenate([x[k] for x in got]) for k in range(3))
    order = np.argsort(seed, kind="stable")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Items(np.array(ids, np.int64), word, first, masks, seed[order], item[order], offset[order], bits)


def overlaps(items: Items, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, first word, words, equal words, item's first word) of verified overlaps of a piece."""
    hits = []
    for mask in items.masks:
        h, at = seeds(word, first, mask)
        maybe = np.flatnonzero(items.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        h, at = h[maybe], at[maybe]
        lo, hi = np.searchsorted(items.seed, h, "left"), np.searchsorted(items.seed, h, "right")
        total = np.cumsum(hi - lo)
        s = 0
        while s < len(h):
            # one diagonal of a document and an item counts once, however many hits it has
            e = max(s + 1, int(np.searchsorted(total, total[s] - (hi[s] - lo[s]) + HITS_AT_ONCE, "right")))
            n = (hi - lo)[s:e]
            which, place = X.ragged(lo[s:e], n), np.repeat(at[s:e], n)
            hits.append(np.unique(np.stack([np.searchsorted(first, place, "right") - 1, items.item[which], place - items.offset[which]]), axis=1))
            s = e
    if not hits:
        return
    for d, i, g in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
        a, b = items.first[i], items.first[i + 1]
        lo, hi = max(g, int(first[d])), min(g + b - a, int(first[d + 1]))
        need = min(WINDOW, b - a)
        if hi - lo < need:
            continue
        same = np.concatenate([[0], np.cumsum(word[lo:hi] == items.word[a + lo - g : a + hi - g])])
        good = np.flatnonzero((same[need:] - same[:-need]) * DEN >= NUM * need)
        if len(good):
            s, e = int(good[0]), int(good[-1]) + need
            yield d, i, lo + s, e - s, int(same[e] - same[s]), a + lo - g + s


def chunks(benchmark: DataFrame, at_once: int = AT_ONCE) -> Iterator[Items]:
    """The items, streamed to the driver, in groups of at most ``at_once`` words (or one item)."""
    ids, texts, n = [], [], 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        size = len(row["text"]) // 2 + 1
        if ids and n + size > at_once:
            yield items_of(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(row["item_id"]), texts.append(row["text"])
        n += size
    if ids:
        yield items_of(ids, texts)


def gathered(pieces: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    """Lists of pieces of ``limit`` bytes of text together, or one piece."""
    some, n = [], 0
    for piece in pieces:
        if some and n + len(piece[1]) > limit:
            yield some
            some, n = [], 0
        some.append(piece)
        n += len(piece[1])
    if some:
        yield some


def found_in(items: Items, rows: pa.RecordBatch, buf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The verified overlaps of a piece of text with a group of items."""
    start, end, word, first = X.words(buf, at, X.LETTER)
    got = np.array(list(overlaps(items, word, first)), np.int64).reshape(-1, 6)
    doc, w, n = got[:, 0], got[:, 2], got[:, 3]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
            pa.array(items.ids[got[:, 1]]),
            pa.array(start[w] - at[doc]),
            pa.array(end[w + n - 1] - at[doc]),
            pa.array(n.astype(np.int32)),
            pa.array(got[:, 4].astype(np.int32)),
        ],
        ["doc_id", "item_id", "start", "end", "n_words", "n_equal"],
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """One row per contaminated document and item: the overlap's bytes [start, end), its words and how many are equal.

    Only items, in groups of a set size, are sent to the executors: the documents are read once and not shuffled. Of
    several groups a worker holds one at a time.
    """
    spark = docs.sparkSession
    groups = [spark.sparkContext.broadcast(group) for group in chunks(benchmark, at_once)]
    if not groups:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(X.pieces(batches, "text"), GATHERED if len(groups) > 1 else 0):
            for group in groups:
                items = group.value
                yield from (found_in(items, *piece) for piece in some)
                if len(groups) > 1:
                    group.__dict__.pop("_value", None)  # read again from the worker's disk for the next pieces

    found = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, SCHEMA)
    best = F.struct("n_equal", (-F.col("start")).alias("s"), "end", "n_words")
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with its columns, without the documents that hold a passage of the benchmark."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")
