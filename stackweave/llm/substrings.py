"""Removal of repeated byte strings by suffix sorting.

Of every text each byte goes that is covered by a WIDTH-byte string which also starts in a document with a smaller
doc_id. Strings are judged on the input. The work is dealt out by content, so that all places of one string meet:

1. Texts that are equal as a whole are one class. Only its first document is looked at further; the others lose all
   bytes (if they have WIDTH).
2. Each WIDTH-byte window has a minimiser, the smallest hash of its GRAM-byte grams, which depends on the window's
   bytes alone. A minimiser that only one document has rules its windows out. Minimisers are counted in buckets of
   hashes; one piece of text sends each only once. A minimiser that over HOT_PIECES pieces, and over one in HOT_SHARE
   of all, send is hot; so there are HOT_SHARE times as many as a piece has at most.
3. The windows left are cut into fragments that share a minimiser, and fragments are dealt into buckets by it: equal
   windows meet in one bucket. Windows of a hot minimiser, of a gram that very many texts have amid other words, are
   fragments of their own, dealt by the hash of all their bytes: no bucket gets all of them. Equal fragments are taken
   together, first in each piece, so that a passage that very many documents share is sent once a piece.
4. In a bucket the windows are suffix-sorted in two stages. A suffix is of type B if it is smaller than its
   successor, the suffix one byte later. Type B is sorted directly, by WIDTH bytes and a few more. The others, of
   type A, follow by a scan over buckets of first bytes in ascending order: the sorted suffixes of a bucket put their
   type A predecessors, in the same order, behind what the predecessor's bucket has so far; a bucket's own
   repetitions of its byte go in rounds. Common prefixes of neighbours then group equal windows, and all but those of
   the smallest doc_id are covered.

Defined results: a null text is empty and loses nothing; texts shorter than WIDTH lose nothing. A null doc_id is left
out. Rows that repeat a doc_id count once, with the text that sorts first. Very long texts are treated whole. Of equal
strings those of the smallest doc_id stay, all of them. An empty table gives no rows. Columns but doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as X
from .ids import copies_of, one_per_id, only

WIDTH = 50
GRAM = 28
PIECE = 2 << 20
BUCKET_BYTES = 16 << 20
#: Pieces that have a minimiser, and their share of all, from which on its windows are dealt one by one.
HOT_PIECES, HOT_SHARE = 512, 64
#: Buckets at least, so that small inputs are dealt as finely as middling ones.
LEAST_BUCKETS = 64


def minimisers(total: np.ndarray, n: int, k: int, width: int = WIDTH) -> np.ndarray:
    """For each of the n - width + 1 windows the smallest hash of its k-byte grams; total is running()."""
    place = np.arange(max(0, n - k + 1))
    m, w, step = X.spans_hash(total, place, place + k), width - k + 1, 1
    while step * 2 <= w:
        m = np.minimum(m[: max(0, len(m) - step)], m[step:])
        step *= 2
    return np.minimum(m[: max(0, len(m) - (w - step))], m[w - step :]) if w > step else m


def runs(windows: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, count) of the runs of consecutive windows with one value."""
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return windows[at], np.diff(np.append(at, len(windows)))


def inside(at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(windows that lie in one document, its number)."""
    n = np.maximum(0, np.diff(at) - width + 1)
    return X.ragged(at[:-1], n), np.repeat(np.arange(len(n)), n)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h * X.BASE) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def doc_keys(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows (document, its keys as raw integers); doc must be sorted."""
    own, count = np.unique(doc, return_counts=True)
    return own, X.binary_rows(key, np.cumsum(count))


def send_minimisers(buckets: int):
    """Rows for buckets: hashes with one document each; and rows (doc, keys) already known to be shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text", PIECE):
            windows, doc = inside(at)
            if not len(windows):
                continue
            m = minimisers(X.running(buf), len(buf), GRAM)
            first, _ = runs(windows, m[windows])
            ids = rows.column("doc").to_numpy()
            key, doc = m[first], ids[np.searchsorted(at, first, "right") - 1]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[keep], doc[keep]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            several = np.repeat(np.diff(np.append(np.flatnonzero(new), len(key))) > 1, np.diff(np.append(np.flatnonzero(new), len(key))))
            known = np.flatnonzero(several)
            known = known[np.argsort(doc[known], kind="stable")]
            own, keys = doc_keys(doc[known], key[known])
            key, doc = key[new], doc[new]
            bucket = bucket_of(key, buckets)
            order = np.lexsort((doc, bucket))
            key, doc, bucket = key[order], doc[order], bucket[order]
            start = np.ones(len(key), bool)
            start[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
            start = np.flatnonzero(start)
            which = np.unique(bucket)
            key_end, run_end = np.searchsorted(bucket, which, "right"), np.searchsorted(bucket[start], which, "right")
            count = np.diff(np.append(start, len(key))).astype(np.int32)
            none = pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.nulls(len(which), pa.int64()), X.binary_rows(key, key_end), X.binary_rows(doc[start], run_end), X.binary_rows(count, run_end)], NAMES)
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(len(own)) % buckets).astype(np.int32)), pa.array(own), keys, none, none], NAMES)

    return run


NAMES = ["bucket", "doc", "keys", "docs", "counts"]


def shared_minimisers(hot: int):
    """Of one bucket: (doc, keys) of hashes that several pieces sent, and what was known before; null and those of over ``hot`` pieces."""

    def run(t: pa.Table) -> pa.Table:
        known = t.filter(pa.compute.is_valid(t["doc"])).select(["doc", "keys"])
        t = t.filter(pa.compute.is_null(t["doc"]))
        join = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        key, doc = join("keys", np.uint64), np.repeat(join("docs", np.int64), join("counts", np.int32))
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        many = pa.table({"doc": pa.nulls(1, pa.int64()), "keys": pa.array([key[begin[size > hot]].tobytes()])})
        twice = np.repeat(size > 1, size)
        key, doc = key[twice], doc[twice]
        order = np.argsort(doc, kind="stable")
        own, keys = doc_keys(doc[order], key[order])
        return pa.concat_tables([known, pa.table({"doc": pa.array(own, pa.int64()), "keys": keys}), many])

    return run


def send_fragments(buckets: int, hot: Broadcast):
    """Of texts with their shared hashes: fragments by bucket. Of equal ones of a piece only the first document's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text", PIECE):
            windows, doc = inside(at)
            if not len(windows):
                continue
            total = X.running(buf)
            value = minimisers(total, len(buf), GRAM)[windows]
            first, count = runs(windows, value)
            of = np.searchsorted(at, first, "right") - 1
            value = value[np.searchsorted(windows, first)]
            lists = rows.column("shared")
            use = np.zeros(len(first), bool)
            begin = np.searchsorted(of, np.arange(rows.num_rows + 1))
            for d, blobs in enumerate(lists.to_pylist()):
                own = slice(begin[d], begin[d + 1])
                use[own] = np.isin(value[own], np.frombuffer(b"".join(blobs), np.uint64))
            first, count, of, value = first[use], count[use], of[use], value[use]
            if not len(first):
                continue
            alone = np.isin(value, hot.value)
            lone = X.ragged(first[alone], count[alone])
            first, count = np.concatenate([first[~alone], lone]), np.concatenate([count[~alone], np.ones(len(lone), count.dtype)])
            of = np.concatenate([of[~alone], np.searchsorted(at, lone, "right") - 1])
            value = np.concatenate([value[~alone], X.spans_hash(total, lone, lone + WIDTH)])
            ids = rows.column("doc").to_numpy()[of]
            start = first - at[of]
            whole = X.spans_hash(total, first, first + count + WIDTH - 1)
            bucket = bucket_of(value, buckets)
            order = np.lexsort((ids, whole, count, bucket))
            again = np.zeros(len(order), bool)
            o, p = order[1:], order[:-1]
            again[1:] = (whole[o] == whole[p]) & (count[o] == count[p]) & (bucket[o] == bucket[p]) & (ids[o] != ids[p])
            done = order[again]
            order = order[~again]
            length = count[order] + WIDTH - 1
            data = buf[X.ragged(first[order], length)]
            which = np.unique(bucket[order])
            end = np.searchsorted(bucket[order], which, "right")
            byte_end = np.concatenate([[0], np.cumsum(length)])[end]
            yield pa.RecordBatch.from_arrays([pa.array(which), X.binary_rows(data, byte_end), X.binary_rows(ids[order], end), X.binary_rows(start[order], end), X.binary_rows(count[order].astype(np.int32), end)], FRAGMENTS)
            # a later document's equal fragment is covered already
            done = done[np.lexsort((start[done], ids[done]))]
            own, n = np.unique(ids[done], return_counts=True)
            end = np.cumsum(n)
            for k in range(len(own)):
                part = done[end[k] - n[k] : end[k]]
                yield pa.RecordBatch.from_arrays([pa.array([int(own[k] % buckets)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([ids[part].tobytes()]), pa.array([start[part].tobytes()]), pa.array([count[part].astype(np.int32).tobytes()])], FRAGMENTS)

    return run


FRAGMENTS = ["bucket", "data", "docs", "starts", "counts"]


def big_endian(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that compares as they do."""
    t = np.concatenate([t, np.zeros(16, np.uint8)])
    out = np.empty(len(t) - 8, np.uint64)
    for r in range(8):
        part = t[r : r + (len(t) - r) // 8 * 8].view(">u8")
        out[r::8] = part[: len(out[r::8])]
    return out


def two_stage(t: np.ndarray, at: np.ndarray, count: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The windows (the first count[i] places of fragment i, which is t[at[i]:at[i + 1]]) in order of their bytes."""
    n = len(t)
    change = np.ones(n, bool)
    change[1:] = t[1:] != t[:-1]
    change[at[:-1]] = True
    opens = np.flatnonzero(change)
    end = np.zeros(n + 1, bool)
    end[at[1:]] = True
    # a run of one byte is of type A if the byte after it, in the fragment, is smaller; the last run is of type B
    after = np.append(opens[1:], n)
    falls = ~end[after] & (t[np.minimum(after, n - 1)] < t[opens])
    a = np.repeat(falls, np.diff(np.append(opens, n)))
    wanted = np.zeros(n, bool)
    wanted[X.ragged(at[:-1], count)] = True
    # the successors of the last windows up to the first of type B
    last = at[:-1] + count - 1
    while len(last):
        last = last[a[last]] + 1
        last = last[~wanted[last]]
        wanted[last] = True
    b = np.flatnonzero(wanted & ~a)
    depth = 56
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    rows = np.empty((len(b), depth + 8), np.uint8)
    step = 1 << 16
    for i in range(0, len(b), step):
        rows[i : i + step, :depth] = padded[b[i : i + step, None] + np.arange(depth)]
    rows[:, depth:] = b.astype(">u8")[:, None].view(np.uint8)
    direct = np.sort(rows.view(f"S{depth + 8}").ravel())
    b = np.frombuffer(direct.tobytes(), np.uint8).reshape(-1, depth + 8)[:, depth:].copy().view(">u8").ravel().astype(np.int64)
    own = np.searchsorted(t[b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def put(sorted_places: np.ndarray, c: int) -> np.ndarray:
        """Deal the type A predecessors to their buckets; those of byte c itself are returned."""
        before = sorted_places[sorted_places > 0] - 1
        before = before[a[before] & wanted[before] & ~end[before + 1]]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.searchsorted(first, np.arange(257))
        for x in np.unique(first[first > c]).tolist():
            waiting[x].append(before[cut[x] : cut[x + 1]])
        return before[cut[c] : cut[c + 1]]

    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = put(now, c)
        direct_c = b[own[c] : own[c + 1]]
        if len(direct_c):
            out.append(direct_c)
            put(direct_c, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_window = np.zeros(n, bool)
    is_window[X.ragged(at[:-1], count)] = True
    return order[is_window[order]]


def equal_to_last(t: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether each window has a common prefix of ``width`` bytes with the one before it."""
    word = big_endian(t)
    same = np.zeros(len(order), bool)
    same[1:] = True
    for o in [*range(0, width - 8, 8), width - 8]:
        i = np.flatnonzero(same)
        same[i] = word[order[i] + o] == word[order[i - 1] + o]
    return same


def covered(t: pa.Table) -> pa.Table:
    """(doc, spans): of one bucket, the windows [start, count] that a smaller document has too, as raw integers."""
    join = lambda x, c, kind: np.frombuffer(b"".join(x[c].to_pylist()), kind)
    known = t.filter(pa.compute.is_null(t["data"]))
    t = t.filter(pa.compute.is_valid(t["data"]))
    doc, start, count = join(t, "docs", np.int64), join(t, "starts", np.int64), join(t, "counts", np.int32).astype(np.int64)
    got = [tuple(join(known, c, k).astype(np.int64) for c, k in (("docs", np.int64), ("starts", np.int64), ("counts", np.int32)))]
    if len(doc):
        at = np.concatenate([[0], np.cumsum(count + WIDTH - 1)])
        data = join(t, "data", np.uint8)
        code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, doc, code))
        first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
        least = doc[first][code]
        later = doc > least
        got.append((doc[later], start[later], count[later]))
        # of equal fragments the first document's place stands for all; its own repetitions get what it gets
        lens = count[first] + WIDTH - 1
        text, at = data[X.ragged(at[first], lens)], np.concatenate([[0], np.cumsum(lens)])
        windows = two_stage(text, at, count[first])
        group = np.cumsum(~equal_to_last(text, windows)) - 1
        frag = np.searchsorted(at, windows, "right") - 1
        owner = doc[first][frag]
        smallest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, owner)
        bad = windows[owner > smallest[group]]
        bad.sort()
        begin, n = runs(bad, np.searchsorted(at, bad, "right")) if len(bad) else (bad, bad)
        frag = np.searchsorted(at, begin, "right") - 1
        # every place of the same fragment in the same document
        mine = order[doc[order] == least[order]]
        place = np.searchsorted(code[mine], np.arange(len(first)), "left"), np.searchsorted(code[mine], np.arange(len(first)), "right")
        many = place[1][frag] - place[0][frag]
        which = mine[X.ragged(place[0][frag], many)]
        got.append((doc[which], start[which] + np.repeat(begin - at[frag], many), np.repeat(n, many)))
    doc, start, count = (np.concatenate([x[k] for x in got]) for k in range(3))
    order = np.lexsort((start, doc))
    own, n = np.unique(doc, return_counts=True)
    return pa.table({"doc": pa.array(own, pa.int64()), "spans": X.binary_rows(np.stack([start[order], count[order]], 1).ravel(), 2 * np.cumsum(n))})


def merged(blobs: list[bytes]) -> np.ndarray:
    """Rows [start, end) of bytes to remove, disjoint and in order."""
    s = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 0] + s[:, 1] + WIDTH - 1)
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], end[np.append(first[1:], len(s)) - 1]], 1)


def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[], [], []]
        for text, blobs in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw, spans = text.encode(), merged(blobs)
            at, kept = 0, []
            for s, e in spans.tolist():
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            out[0].append(hashlib.sha256(b"".join(kept)).hexdigest()), out[1].append(spans.ravel().tolist()), out[2].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(x) // 2 for x in out[1]], pa.int64()), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())], ["doc", "n_spans", "kept_sha256", "spans", "kept"])


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<long>: starts and ends of the removed runs).

    With ``with_text`` also kept, the remaining bytes.
    """
    with scratch.temporary(docs.sparkSession) as keep:
        return keep(without_repeats(one_per_id(docs), with_text), "spans")


def without_repeats(docs: DataFrame, with_text: bool) -> DataFrame:
    """dedup_substrings() of documents (doc, text), one a doc."""
    marks = scratch.written(docs.select("doc", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit("\x00"), "text").alias("t1"), F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    key = ["t0", "t1", "n_bytes"]
    n_docs, n = marks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    copies = scratch.written(copies_of(marks.where(F.col("n_bytes") >= WIDTH), key, n_docs).select("doc", "n_bytes"), "copies")
    firsts = only(docs.where(F.octet_length("text") >= WIDTH), copies.select("doc"), "left_anti")
    buckets = max(LEAST_BUCKETS, int(n // BUCKET_BYTES) + 1)
    sent = firsts.mapInArrow(send_minimisers(buckets), "bucket int, doc long, keys binary, docs binary, counts binary")
    often = max(HOT_PIECES, int(n // PIECE) // HOT_SHARE)
    found = scratch.written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_minimisers(often), "doc long, keys binary"), "hits")
    hot = np.frombuffer(b"".join(r["keys"] for r in found.where("doc IS NULL").toLocalIterator()), np.uint64)  # HOT_SHARE pieces' keys at most
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    hits = found.where("doc IS NOT NULL")
    lists = hits.groupBy("doc").agg(F.collect_list("keys").alias("shared"))
    with_hits = only(firsts, hits.select("doc").distinct()).join(lists, "doc")
    fragments = with_hits.mapInArrow(send_fragments(buckets, hot), "bucket int, data binary, docs binary, starts binary, counts binary")
    spans = scratch.written(fragments.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(covered, "doc long, spans binary"), "spans")
    hit = spans.select("doc").distinct()
    cut = only(docs, hit).join(spans.groupBy("doc").agg(F.collect_list("spans").alias("spans")), "doc").select("doc", "text", "spans").mapInArrow(remove, "doc long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    plain = only(docs, hit.unionAll(copies.select("doc")), "left_anti")
    empty = F.array().cast("array<long>")
    kept = plain.select("doc", F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), empty.alias("spans"), F.col("text").cast("binary").alias("kept"))
    gone = copies.select("doc", F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.lit(0).cast("long"), "n_bytes").alias("spans"), F.lit(b"").alias("kept"))
    parts = [x if with_text else x.drop("kept") for x in (cut, kept, gone)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.join(marks.select("doc", "n_bytes"), "doc").select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), "n_spans", "kept_sha256", "spans", *(["kept"] if with_text else []))
