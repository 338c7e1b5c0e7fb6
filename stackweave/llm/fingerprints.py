"""Document fingerprints by winnowing.

Hashes roll over the K-byte grams of a text; of each window of T - K + 1 grams the one with the smallest hash is
chosen, the rightmost among equals. Any common string of at least T bytes then contributes a common choice, at
positions that are kept. A text of fewer grams is one window; of fewer than K bytes, one gram; empty, none.

Null counts as the empty text. Two empty fingerprints are alike (1). Repeated rows of a doc_id follow each other in
order of their texts; a null doc_id is the smallest. Very long texts are fingerprinted whole, in slices that overlap
by a window. A single document is its own next one. An empty table gives no rows. fingerprint() passes columns through
and replaces those named like a result; compare_with_next() takes doc_id and text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

K, T = 16, 128
HEX = 10  # characters of a hash of 40 bits
#: Bytes of text that are hashed at once.
SLICE = 4 << 20
#: Ranges of documents: of RANGE_BYTES up to MANY of them, then larger ones, of at most LARGEST_RANGE bytes.
RANGE_BYTES, MANY, LARGEST_RANGE = 6 << 20, 4096, 1 << 30


def winnow(buf: np.ndarray, at: np.ndarray, k: int = K, t: int = T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of 40 bits, positions in their document, end of each document's choice)."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        part, own = buf[at[i] : at[j]], at[i : j + 1] - at[i]
        out.append(winnow_piece(part, own, k, t) if len(part) <= SLICE else winnow_slices(part, k, t))
        i = j
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum([x[2][-1] for x in out])])
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([x[2] + b for x, b in zip(out, before)])


def winnow_slices(buf: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long text: each slice has the windows that begin in it; a choice that two slices make counts once."""
    hashes, places, last = [], [], -1
    windows = len(buf) - t + 1
    for s in range(0, windows, SLICE):
        h, pos, _ = winnow_piece(buf[s : min(windows, s + SLICE) + t - 1], np.array([0, min(windows, s + SLICE) + t - 1 - s]), k, t)
        new = pos + s > last  # choices only move to the right
        hashes.append(h[new]), places.append(pos[new] + s)
        last = int(pos[-1]) + s
    h = np.concatenate(hashes)
    return h, np.concatenate(places), np.array([len(h)])


def winnow_piece(buf: np.ndarray, at: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """winnow() of fewer than 2 ** 24 bytes, so that a place fits beside a hash."""
    w = t - k + 1
    n = len(buf)
    length = np.diff(at)
    total = X.running(buf)
    low = np.uint64((1 << 24) - 1)
    grams = max(0, n - k + 1)
    place = np.arange(grams)
    # 40 bits of hash, then the place from the right: the minimum is the rightmost of the smallest
    key = (X.spans_hash(total, place, place + k) & ~low) | (low - (place.astype(np.uint64) & low))
    m, step = key, 1
    while step * 2 <= w:
        m = np.minimum(m[: max(0, len(m) - step)], m[step:])
        step *= 2
    if w > step and len(m):
        m = np.minimum(m[: max(0, len(m) - (w - step))], m[w - step :])
    count = length - k + 1 - w + 1  # whole windows of each document
    full = np.flatnonzero(count > 0)
    which = X.ragged(at[:-1][full], count[full])
    doc = np.repeat(full, count[full])
    value = m[which]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    docs, values = [doc[new]], [value[new]]
    part = np.flatnonzero((count <= 0) & (length >= k))
    if len(part):
        lens = length[part] - k + 1
        docs.append(part)
        values.append(np.minimum.reduceat(key[X.ragged(at[:-1][part], lens)], np.cumsum(lens) - lens))
    doc, value = np.concatenate(docs), np.concatenate(values)
    pos = (low - (value & low)).astype(np.int64)
    whole = np.flatnonzero((length > 0) & (length < k))
    h = value >> np.uint64(24)
    if len(whole):
        doc = np.concatenate([doc, whole])
        h = np.concatenate([h, X.spans_hash(total, at[:-1][whole], at[1:][whole]) >> np.uint64(24)])
        pos = np.concatenate([pos, at[:-1][whole]])
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    return h[order], pos[order] - at[doc], np.searchsorted(doc, np.arange(len(length)), "right")


def hex_rows(h: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One string per document: HEX characters a hash, in order of position."""
    raw = np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 3:]
    text = np.frombuffer(raw.tobytes().hex().encode(), np.uint8)
    return X.binary_rows(text, ends * HEX).cast(pa.string())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the distinct hashes; both sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with fingerprint (string) and fingerprint_positions (bytes from the text's start)."""
    keep = [c for c in docs.columns if c.lower() not in ("fingerprint", "fingerprint_positions")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text"):
            h, pos, ends = winnow(buf, at)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), hex_rows(h, ends), X.list_rows(pos.astype(np.int32), ends)], [*keep, "fingerprint", "fingerprint_positions"])

    return docs.select(*keep).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + ["fingerprint string, fingerprint_positions array<int>"]))


def ranges_of(n_bytes: int) -> int:
    return max(min(MANY, n_bytes // RANGE_BYTES + 1), -(-n_bytes // LARGEST_RANGE))


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are above the value."""
    if not bounds:
        return F.lit(0)
    at = np.array(bounds, np.int64)
    return F.pandas_udf(lambda x: pd.Series((len(at) - np.searchsorted(at, x.to_numpy(), "right")).astype(np.int32)), "int")(column)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(range, halo, doc, text): documents in ranges of descending id, each with the first text of the next one.

    Only the documents' ids decide on the ranges; the texts are shuffled once. A range's halo row is the document
    that follows its last one; after the last range comes the first document of all.
    """
    least = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n = ranges_of(size["b"] or 0)
    bounds: list[int] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        bounds = sorted({int(x) for x in docs.select(F.percentile_approx("doc", shares, max(100_000, 10 * n))).first()[0]})
    docs = docs.withColumn("range", range_of(F.col("doc"), bounds))
    # one id per range comes to the driver, one a GB of a large input
    heads = sorted(((r["range"], r["id"]) for r in docs.groupBy("range").agg(F.max("doc").alias("id")).collect()))
    spark = docs.sparkSession
    after = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]  # i = 0: the last range gets the first head
    halo = spark.createDataFrame(after, "range int, doc long")
    first = docs.drop("range").join(F.broadcast(halo), "doc").groupBy("range", "doc").agg(F.min("text").alias("text"))
    rows = docs.select("range", F.lit(0).alias("halo"), "doc", "null_id", "text").unionAll(first.select("range", F.lit(1).alias("halo"), "doc", F.lit(False), "text"))
    return rows.repartition(max(1, len(heads)), "range").sortWithinPartitions("range", "halo", F.col("doc").desc(), "text"), len(heads)


def edited(buf: np.ndarray, at: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, code points of each text): texts 0 to last - 1 with their last third replaced by the next's start."""
    leads = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(leads, at)
    n = np.diff(first)
    leads = np.append(leads, len(buf))
    k = n[:last] // 3
    cut = np.where(k > 0, leads[first[:last] + n[:last] - k], at[1 : last + 1])
    take = np.minimum(k, n[1 : last + 1])
    stop = np.where(take > 0, leads[np.minimum(first[1 : last + 1] + take, len(leads) - 1)], at[1 : last + 1])
    start = np.empty(2 * last, np.int64)
    length = np.empty(2 * last, np.int64)
    start[0::2], length[0::2] = at[:last], cut - at[:last]
    start[1::2], length[1::2] = at[1 : last + 1], stop - at[1 : last + 1]
    return buf[X.ragged(start, length)], np.concatenate([[0], np.cumsum(length[0::2] + length[1::2])]), n


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions).

    The next document is the one with the next smaller doc_id; after the last comes the first. The edited text has
    the last floor(n_chars / 3) code points replaced by the first as many of the next document, or all it has.
    """
    rows, _ = with_next(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part, _, _ in X.pieces([batch], "text"):
                t = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()
                if not t:
                    continue
                held = t[0].slice(t[0].num_rows - 1)
                if t[0].num_rows > 1:
                    yield done(t[0])

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        """All rows but the last and the halo rows; the last row is only the next one's text."""
        last = rows.num_rows - 1
        buf, at = X.utf8(rows.column("text"))
        new, new_at, n = edited(buf, at, last)
        h, pos, ends = winnow(buf, at)
        h2, _, ends2 = winnow(new, new_at)
        cut = lambda x, e: [np.unique(p) for p in np.split(x, e[:-1])]
        own, other = cut(h, ends), cut(h2, ends2)
        use = np.flatnonzero(rows.column("halo").slice(0, last).to_numpy() == 0)
        raw = new.tobytes()
        out = [
            pa.array(rows.column("doc").to_numpy()[:last], mask=rows.column("null_id").to_numpy(zero_copy_only=False)[:last]),
            pa.array(n[:last].astype(np.int64)),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(new_at[:-1].tolist(), new_at[1:].tolist())]),
            hex_rows(h, ends).slice(0, last),
            hex_rows(h2, ends2),
            pa.array([likeness(own[i], other[i]) for i in range(last)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in range(last)], pa.float64()),
            X.list_rows(pos.astype(np.int32), ends).slice(0, last),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
        return pa.RecordBatch.from_arrays(out, names).take(pa.array(use))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
    return rows.mapInArrow(run, schema)
