"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles. Two documents link when den * |A n B| >= num * |A u B|.

Size bands: sizes are cut into geometric bands; a pair belongs to the band of its smaller set. A document is in
its own band, and in the band below if a set there can still be similar enough.

Parity sketches: each shingle flips one bit of a sketch, so that equal shingles cancel and the Hamming distance of
two sketches is at most the size of the symmetric difference. For a pair of a band that is at most
D = floor((den - num) * (|A| + |B|) / (den + num)). The (virtual, 2 ** 64 bit wide) sketch is cut into D + 1 + SPARE
parts; by the pigeonhole principle more than SPARE parts of a linked pair agree. A part that no shingle falls into
says nothing: it is not joined on, unless a document has over SPARE of them. Parts join by the XOR of the hashes of
their set bits.

Candidates of a part come as pairs if few documents share it; else the documents of a part are compared within blocks,
by a second, explicit parity sketch, and give a spanning forest of what may link, never all pairs. The same explicit
sketch sifts the pairs. All that is left is verified on the whole sets. Parts of several blocks, or with a failed edge,
are compared anew, without the failed edges, until they hold nothing that could join two components: no link between
different texts is lost. Only what is outside a part's largest component is compared with the rest of it, so that a
part of very many near copies costs a multiple of its documents, not their square. Documents of a part that very many
share are never gathered in one group: they go to the blocks directly. All links lie within components: there each pair of classes is compared once, on the whole
sets, for the numbers of links; pairs are counted in blocks and never listed. That work grows with the square of a
component's classes.

Equal texts are one class from the start: its smallest doc_id stands for it. Null and empty texts, or texts without
words, have no shingles and link with nothing. A null doc_id is left out. Rows that repeat a doc_id count once, with
the text that sorts first. Very long texts take part whole. An empty table gives no rows. link() reads doc_id and text
alone; keep_one() passes all columns through, whatever their names, and keeps rows without a doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as X
from .components import components
from .ids import BROADCAST_IDS, copies_of, one_per_id, only

#: Documents of a part up to which all its pairs are listed (a constant number of rows a document).
FEW = 6
#: Documents of a block; a part of more is compared block by block.
BLOCK = 4096
#: Documents of a part from which on they are not gathered, hot parts of each of a document's keys at most, and the share of
#: documents (one of so many) by which they are found.
HOT_DOCS, HOT_PARTS, SEEN = 100_000, 30_000, 64
#: Bytes of text whose keys one bucket holds.
BUCKET_BYTES = 24 << 20
#: Edges a document gives at once when a part is compared anew. All get their turn.
AT_ONCE = 32
ROUNDS = 200
#: Documents and shingles of a block when links are counted; larger components are counted block by block.
COUNT_DOCS, COUNT_SHINGLES = 2048, 1 << 19
#: Documents up to which those of a shingle are counted pair by pair, above by matrix products.
RARE = 32


@dataclass(frozen=True)
class Rule:
    words: int = 3
    num: int = 90
    den: int = 100

    @lru_cache(1)
    def bands(self) -> list[int]:
        """First sizes of the bands. Each is at least den / num times as wide as the last size before it."""
        at = [1]
        while at[-1] < 1 << 40:
            at.append(max(at[-1] + 1, -(-at[-1] * self.den * 5 // (self.num * 4))))
        return at

    def differ(self, total: int) -> int:
        """The largest symmetric difference of a linked pair with |A| + |B| = total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def band_of(self, n: int) -> int:
        return int(np.searchsorted(self.bands(), n, "right")) - 1

    def member_of(self, n: int) -> list[int]:
        """Bands of a set of n shingles: its own, and the one below if a set there can be similar but not equal."""
        own = self.band_of(n)
        below = [own - 1] if own and n * self.num <= (self.bands()[own] - 1) * self.den else []
        return [own, *(b for b in below if self.parts(b)[0])]

    @lru_cache(None)  # noqa: B019
    def parts(self, band: int) -> tuple[int, int]:
        """(D, SPARE) of a band. Where D is 0 only equal sets link: one part holds the whole set."""
        top = self.bands()[band + 1] - 1
        d = self.differ(top + top * self.den // self.num)
        return d, 1 + d // 12 if d else 0

    @lru_cache(None)  # noqa: B019
    def width(self, band: int) -> int:
        """Bytes of the explicit sketch in a band: about 4 bits a shingle."""
        return max(64, min(1 << 16, 1 << int(np.ceil(np.log2(self.bands()[band + 1] / 2)))))


def band_sketch(rule: Rule, band: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the parts to join on, explicit parity sketch) of a set of shingle hashes."""
    d, spare = rule.parts(band)
    n = d + 1 + spare
    h = X.mix(h + np.uint64(band))
    part = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    own, begin = np.unique(part[order], return_index=True)
    word = np.bitwise_xor.reduceat(X.mix(h[order]), begin)
    keys = X.mix(word + X.mix(own.astype(np.uint64) + np.uint64(band << 40)))
    if n - len(own) > spare:
        empty = np.setdiff1d(np.arange(n), own).astype(np.uint64)
        keys = np.concatenate([keys, X.mix(X.mix(empty + np.uint64(band << 40)))])
    bits = rule.width(band) * 8
    bit = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    # the low byte holds the band, so that a key is of one band only
    return (keys & ~np.uint64(255)) | np.uint64(band), np.packbits(bit.astype(np.uint8))


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, n, band, keys, sketch) per document and band; one row with a null band if it can link in none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text"):
            _, _, word, first = X.words(buf, at)
            doc, size, band, keys, sketch = [], [], [], [], []
            for d, s in zip(rows.column("doc").to_pylist(), X.shingles(word, first, rule.words)):
                for b in (rule.member_of(len(s)) if len(s) else []) or [None]:
                    k, e = band_sketch(rule, b, s) if b is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
                    doc.append(d), size.append(len(s)), band.append(b), keys.append(k), sketch.append(e)
            ends = np.cumsum([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(band, pa.int32()),
                    X.list_rows(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64), ends),
                    X.binary_rows(np.concatenate(sketch or [np.zeros(0, np.uint8)]), np.cumsum([len(e) for e in sketch])),
                ],
                ["doc", "n", "band", "keys", "sketch"],
            )

    return docs.select("doc", "text").mapInArrow(run, "doc long, n long, band int, keys array<long>, sketch binary")


def hot_parts(table: DataFrame, n_docs: int) -> np.ndarray:
    """Sorted keys of parts that very many documents seem to share, from one of SEEN documents, chosen by hash.

    They only take another way, so that no group holds all their documents; which keys are found changes no result. There
    are at most the keys of a document times HOT_PARTS of them.
    """
    least = max(HOT_DOCS, n_docs // HOT_PARTS) // SEEN
    some = table.where((F.col("band").isNotNull()) & (F.pmod(F.xxhash64("doc"), F.lit(SEEN)) == 0)).select(F.explode("keys").alias("key"))
    found = some.groupBy("key").count().where(F.col("count") >= max(2, least)).select("key").toArrow()["key"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def members_of(table: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, a, null, g) of the documents of hot parts, as shared_parts() gives them; no part is gathered."""
    spark = table.sparkSession
    keys = F.broadcast(spark.createDataFrame(pa.table({"key": hot.view(np.int64)})))  # bounded, see hot_parts()
    each = table.where("band IS NOT NULL").select(F.col("doc").alias("a"), F.explode("keys").alias("key")).join(keys, "key").distinct()
    counted = each.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    return each.join(F.broadcast(counted), "key").select("key", "a", F.lit(None).cast("long").alias("b"), "g")


def packed(rows: DataFrame, buckets: int, hot: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """(bucket, keys, docs, counts): keys of many documents in one row per bucket, as raw 64-bit integers.

    docs are the documents in order, counts how many keys each has in the row. Of a key that several documents of a
    piece share, all are kept: the part's members are needed. Hot keys are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("keys")
            key = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(b.column("doc").to_numpy(), lists.value_lengths().to_numpy())
            if len(shared.value):
                rest = ~np.isin(key, shared.value)
                key, doc = key[rest], doc[rest]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, doc, bucket = key[order], doc[order], bucket[order]
            new = np.ones(len(key), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
            runs = np.flatnonzero(new)
            own = np.unique(bucket)
            key_end, run_end = np.searchsorted(bucket, own, "right"), np.searchsorted(bucket[runs], own, "right")
            count = np.diff(np.append(runs, len(key))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), X.binary_rows(key, key_end), X.binary_rows(doc[runs], run_end), X.binary_rows(count, run_end)], ["bucket", "keys", "docs", "counts"])

    return rows.select("doc", "keys").mapInArrow(run, "bucket int, keys binary, docs binary, counts binary")


def shared_parts(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs (key, a, b) of parts that few share; (key, a, null) for each document of the others."""
    join = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    key, doc = join("keys", np.uint64), np.repeat(join("docs", np.int64), join("counts", np.int32))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    begin = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    out = []
    for g in range(2, FEW + 1):
        at = begin[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                out.append((key[at], doc[at + i], doc[at + j]))
    few = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    pairs = np.unique(np.stack([few[1], few[2], (few[0].astype(np.uint64) & np.uint64(255)).astype(np.int64)]), axis=1) if len(few[0]) else np.zeros((3, 0), np.int64)
    many = size > FEW
    at = X.ragged(begin[many], size[many])
    keys = np.concatenate([pairs[2], key[at].view(np.int64)])
    a, b = np.concatenate([pairs[0], doc[at]]), np.concatenate([pairs[1], doc[at]])
    g = np.concatenate([np.full(pairs.shape[1], 2), np.repeat(size[many], size[many])])
    return pa.table({"key": keys, "a": a, "b": pa.array(b, mask=np.arange(len(b)) >= pairs.shape[1]), "g": g.astype(np.int64)})


def close_enough(pairs: DataFrame, table: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b, band) those that the explicit sketches' Hamming distance allows to link."""
    side = lambda x: table.select(F.col("doc").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            c = {x: p.column(x) for x in p.schema.names}
            bits = [np.frombuffer(b"".join(c[x].to_pylist()), np.uint8) for x in ("s_a", "s_b")]
            ends = np.cumsum([len(x) for x in c["s_a"].to_pylist()])
            total = np.concatenate([[0], np.cumsum(np.bitwise_count(bits[0] ^ bits[1]), dtype=np.int64)])
            apart = np.diff(total[np.concatenate([[0], ends])])
            near = apart * (rule.den + rule.num) <= (rule.den - rule.num) * (c["n_a"].to_numpy() + c["n_b"].to_numpy())
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(near)), c["b"].filter(pa.array(near))], ["a", "b"])

    joined = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).where(sizes_fit(rule))
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long").distinct()


def sizes_fit(rule: Rule):
    return F.least("n_a", "n_b") * rule.den >= F.greatest("n_a", "n_b") * rule.num


def near_pairs(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(Hamming distances, whether they and the sizes allow a link) of all rows of sketches a with all of b."""
    apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(-1, dtype=np.int64)
    small, large = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
    return apart, (apart * (rule.den + rule.num) <= (rule.den - rule.num) * (small + large)) & (small * rule.den >= large * rule.num)


def sketch_words(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), -1).view(np.uint64)


def rows_at_once(bits: np.ndarray, others: int) -> int:
    return max(1, (16 << 20) // (bits.shape[1] * 8 * max(1, others)))


LINKS = "key long, a long, b long, more boolean"


def links_of(key: pa.ChunkedArray, a: list[int], b: list[int], more: list[bool]) -> pa.Table:
    return pa.table({"key": key.slice(0, 1).take(pa.array(np.zeros(len(a), np.int64))), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more, pa.bool_())})


def with_sketches(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.withColumn("band", F.col("key").bitwiseAND(255).cast("int")).join(table.select("doc", "band", "n", "sketch"), ["doc", "band"])


def ordered(links: DataFrame) -> DataFrame:
    return links.select("key", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "more")


def forests(rows: DataFrame, table: DataFrame, rule: Rule) -> DataFrame:
    """Links (key, a, b, more) from parts (key, doc, g) that many documents share: a spanning forest of what may link.

    A part's documents are dealt into blocks by hash, and each block is a group on its own; what links across blocks is
    for forests_anew(), when most documents of a part have one component.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("g") / BLOCK)).cast("int")
    dealt = with_sketches(rows, table).withColumn("i", F.pmod(F.xxhash64("doc", "key"), blocks).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc")
        doc, n, bits = t["doc"].to_numpy(), t["n"].to_numpy(), sketch_words(t)
        part = np.arange(len(doc))  # the component of each document so far
        a, b = [], []
        step = rows_at_once(bits, len(doc))
        for s in range(0, len(doc), step):
            e = min(len(doc), s + step)
            apart, near = near_pairs(bits[s:e], n[s:e], bits[:e], n[:e], rule)
            near &= np.arange(e)[None, :] < np.arange(s, e)[:, None]
            for v in np.flatnonzero(near.any(1)).tolist():
                us = np.flatnonzero(near[v])
                us = us[part[us] != part[s + v]]
                if not len(us):
                    continue
                # the nearest of each other component
                us = us[np.argsort(apart[v, us], kind="stable")]
                others, first = np.unique(part[us], return_index=True)
                for u in us[np.sort(first)].tolist():
                    a.append(doc[s + v]), b.append(doc[u])
                part[np.isin(part, others)] = part[s + v]
        return links_of(t["key"], a, b, [False] * len(a))

    return ordered(dealt.select("key", "i", "doc", "n", "sketch").groupBy("key", "i").applyInArrow(run, LINKS))


def forests_anew(rows: DataFrame, table: DataFrame, label: DataFrame, failed: DataFrame, rule: Rule, large: bool) -> DataFrame:
    """Links (key, a, b, more) that may join two components, from parts (key, doc, g) that may hold several.

    A part of one block is one group. Of a larger one (large: there are some) only documents outside its largest
    component are compared with all others: with each other, and with those of the largest, in pairs of blocks. A part of
    one component then sends nothing, and one that is nearly so costs the documents left over times its documents. Each
    document gives its AT_ONCE nearest; more marks that it has others.
    """
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    named = rows.join(label.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    one = F.lit(0)
    groups = named.where(F.col("g") <= BLOCK).select("key", "doc", "component", F.lit(True).alias("rest"), one.alias("own"), F.array(group(0, one, one)).alias("groups"))
    if large:
        named = scratch.written(named.where(F.col("g") > BLOCK), "named")
        each = named.groupBy("key", "component").agg(F.count("*").alias("c"))
        parts = each.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("g")).where("m < g")
        parts = scratch.written(parts, "open-parts")
        named = named.drop("g").join(F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts, "key")
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("doc", "key"), n).cast("int")
        every = lambda n: F.sequence(F.lit(0), n - 1)
        left, most = blocks(F.col("g") - F.col("m")), blocks(F.col("m"))
        # two blocks of what is left over (kind 0), or one of these and one of the largest component (kind 1)
        among = F.transform(every(left), lambda o: group(0, F.least(o, own(left)), F.greatest(o, own(left))))
        to_main = F.transform(every(most), lambda o: group(1, own(left), o))
        of_main = F.transform(every(left), lambda o: group(1, o, own(most)))
        rest = F.col("component") != F.col("main")
        groups = groups.unionByName(named.select("key", "doc", "component", rest.alias("rest"), own(left).alias("own"), F.when(rest, F.concat(among, to_main)).otherwise(of_main).alias("groups")))
    no = failed.groupBy(F.col("a").alias("doc")).agg(F.collect_set("b").alias("no"))
    dealt = with_sketches(groups, table).join(no, "doc", "left").select("key", "doc", "component", "rest", "own", "n", "sketch", "no", F.inline("groups"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc")
        doc, n, comp, own, rest = (t[c].to_numpy() for c in ("doc", "n", "component", "own", "rest"))
        bits, inner, cross = sketch_words(t), t["kind"][0].as_py() == 0, t["i"][0].as_py() != t["j"][0].as_py()
        rows, columns = (np.arange(len(doc)), np.arange(len(doc))) if inner else (np.flatnonzero(rest), np.flatnonzero(~rest))
        column_of = np.full(len(doc), -1)
        column_of[columns] = np.arange(len(columns))
        # pairs that failed, from both ends
        place = {d: k for k, d in enumerate(doc.tolist())}
        bad = [(k, place[x]) for k, xs in enumerate(t["no"].to_pylist()) for x in xs or () if x in place]
        bad = np.array(bad + [(y, x) for x, y in bad], np.int64).reshape(-1, 2)
        bad = bad[column_of[bad[:, 1]] >= 0]
        bad = bad[np.argsort(bad[:, 0], kind="stable")]
        a, b, more = [], [], []
        step = rows_at_once(bits, len(columns))
        for s in range(0, len(rows), step):
            v = rows[s : s + step]
            apart, near = near_pairs(bits[v], n[v], bits[columns], n[columns], rule)
            near &= comp[v][:, None] != comp[columns][None, :]
            if inner:
                near &= columns[None, :] < v[:, None]
                if cross:
                    near &= own[v][:, None] != own[columns][None, :]
            lo, hi = np.searchsorted(bad[:, 0], v, "left"), np.searchsorted(bad[:, 0], v, "right")
            near[np.repeat(np.arange(len(v)), hi - lo), column_of[bad[X.ragged(lo, hi - lo), 1]]] = False
            for k in np.flatnonzero(near.any(1)).tolist():
                us = np.flatnonzero(near[k])
                more += [len(us) > AT_ONCE] * min(len(us), AT_ONCE)
                us = us[np.argsort(apart[k, us], kind="stable")][:AT_ONCE]
                a += [doc[v[k]]] * len(us)
                b += doc[columns[us]].tolist()
        return links_of(t["key"], a, b, more)

    return ordered(dealt.groupBy("key", "kind", "i", "j").applyInArrow(run, LINKS))


def shingle_sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """(doc, set): the sorted shingle hashes of the documents with the ids, as raw 64-bit integers."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text"):
            _, _, word, first = X.words(buf, at)
            got = list(X.shingles(word, first, rule.words))
            yield pa.RecordBatch.from_arrays([rows.column("doc"), X.binary_rows(np.concatenate(got or [np.zeros(0, np.uint64)]), np.cumsum([len(x) for x in got]))], ["doc", "set"])

    return only(docs, ids).mapInArrow(sets, "doc long, set binary")


def verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """pairs (a, b) with linked boolean, from the whole sets of both texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            linked = []
            for x, y in zip(p.column("set_a").to_pylist(), p.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(rule.den * both >= rule.num * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    table = scratch.written(shingle_sets(docs, ids, rule), "sets")
    joined = pairs.join(table.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(table.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, linked boolean")


def link_counts(sets: list[np.ndarray], own: np.ndarray | None, rule: Rule) -> np.ndarray:
    """The links of each set with the others; given blocks (own), only with those of another block."""
    n = np.array([len(x) for x in sets], np.int64)
    m = len(n)
    owner = np.repeat(np.arange(m), n)
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    size = np.diff(np.append(begin, len(shingle)))
    both = np.zeros((m, m), np.float32 if n.max() < 1 << 24 else np.float64)  # whole numbers are exact
    rare = RARE if m > 2 * RARE else 1
    for g in np.unique(size[(size > 1) & (size <= rare)]).tolist():
        at = begin[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                np.add.at(both, (owner[at + i], owner[at + j]), 1)
    at, size = begin[size > rare], size[size > rare]
    step = max(1, (8 << 20) // m)
    for s in range(0, len(at), step):
        k = size[s : s + step]
        has = np.zeros((m, len(k)), both.dtype)
        has[owner[X.ragged(at[s : s + step], k)], np.repeat(np.arange(len(k)), k)] = 1
        both += has @ has.T
    count = np.zeros(m, np.int64)
    for v in range(m - 1):
        same = both[v, v + 1 :].astype(np.int64)
        linked = (same > 0) & (rule.den * same >= rule.num * (n[v] + n[v + 1 :] - same))
        if own is not None:
            linked &= own[v + 1 :] != own[v]
        count[v] += linked.sum()
        count[v + 1 :] += linked
    return count


def degrees(label: DataFrame, sizes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(class, n_linked): the links of each class with other classes, of label (id, component) and sizes (doc, n).

    A component of two has one link. Small components are counted many in a group; the documents of a large one are
    dealt into blocks by hash, and each pair of blocks is a group. The groups' counts are summed.
    """
    members = scratch.written(label.join(sizes.withColumnRenamed("doc", "id"), "id").select("id", "component", "n"), "members")
    whole = scratch.written(members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "whole")
    pairs = members.join(whole.where("m = 2"), "component").select(F.col("id").alias("class"), F.lit(1).cast("long").alias("n_linked"))
    large = whole.where("m > 2").withColumn("blocks", F.greatest(F.ceil(F.col("m") / COUNT_DOCS), F.ceil(F.col("total") / COUNT_SHINGLES)).cast("int"))
    mine = members.join(large, "component").select(F.col("id").alias("doc"), "component", "blocks")
    small = large.where("blocks = 1").agg(F.sum("total")).first()[0] or 0
    groups = int(small // COUNT_SHINGLES) + 1
    mine = mine.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    dealt = mine.select("doc", "component", "own", one.alias("small"), F.when(one, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component")).alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = scratch.written(shingle_sets(docs, mine.select("doc").distinct(), rule), "component-sets")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("component")
        comp, own = t["component"].to_numpy(), t["own"].to_numpy()
        got = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        cross = t["i"][0].as_py() != t["j"][0].as_py()
        edge = [*np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])).tolist(), len(comp)]
        count = np.concatenate([link_counts(got[s:e], own[s:e] if cross else None, rule) for s, e in zip(edge, edge[1:])])
        return pa.table({"class": t["doc"], "n": pa.array(count)})

    counted = dealt.join(sets, "doc").groupBy("small", "g", "i", "j").applyInArrow(run, "class long, n long")
    return pairs.unionAll(counted.groupBy("class").agg(F.sum("n").alias("n_linked")))


def link(docs: DataFrame, rule: Rule = Rule(), count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_linked) per document.

    class_id is the smallest doc_id with the same text, component_id the smallest that links reach (itself
    included), n_linked the number of other classes that the class links with (without
    count: null).
    """
    with scratch.temporary(docs.sparkSession) as keep:
        return keep(linked_classes(one_per_id(docs), rule, count), "links")


def linked_classes(docs: DataFrame, rule: Rule, count: bool) -> DataFrame:
    """link() of documents (doc, text), one a doc."""
    spark = docs.sparkSession
    marks = scratch.written(docs.select("doc", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit("\x00"), "text").alias("t1"), F.octet_length("text").cast("long").alias("t2")), "texts")
    n_docs, n_bytes = marks.agg(F.count("*"), F.coalesce(F.sum("t2"), F.lit(0))).first()
    copies = scratch.written(copies_of(marks, ["t0", "t1", "t2"], n_docs).select("doc", "class"), "copies")
    firsts = only(docs, copies.select("doc"), "left_anti")
    table = scratch.written(sketches(firsts, rule), "sketches")
    buckets = max(12, int(n_bytes // BUCKET_BYTES) + 1)
    hot = hot_parts(table, n_docs)
    parts = packed(table.where("band IS NOT NULL"), buckets, hot).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_parts, "key long, a long, b long, g long")
    if len(hot):
        parts = parts.unionByName(members_of(table, hot))
    shared = scratch.written(parts, "parts")
    few = shared.where("b IS NOT NULL").select("a", "b", F.col("key").cast("int").alias("band")).distinct()
    many = shared.where("b IS NULL").select("key", F.col("a").alias("doc"), "g")
    biggest = many.agg(F.max("g")).first()[0]
    many, large = (many, biggest > BLOCK) if biggest else (None, False)
    sketch = table.where("band IS NOT NULL").drop("keys")
    near = scratch.written(close_enough(few, sketch, rule).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near")
    linked = label = failed = None
    for _ in range(ROUNDS):
        # of the sifted pairs one per document first; then those that still join two components, one for each two
        pairs = near
        if linked is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
            pairs = pairs.join(label.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(label.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")
            pairs = pairs.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
        else:
            pairs = pairs.groupBy("a").agg(F.min("b").alias("b"))
        pairs = pairs.withColumn("key", F.lit(None).cast("long")).withColumn("more", F.lit(False))
        if many is not None:
            pairs = pairs.unionByName(forests(many, sketch, rule) if label is None else forests_anew(many, sketch, label, failed, rule, large))
        pairs = scratch.written(pairs, "pairs")
        found = pairs.select("a", "b").distinct()
        if found.isEmpty() and not (label is None and large):
            break
        done = scratch.written(verified(found, docs, rule), "verified")
        yes, no = done.where("linked").select("a", "b"), done.where("NOT linked").select("a", "b")
        linked = yes if linked is None else linked.unionAll(yes)
        failed = no if failed is None else failed.unionAll(no)
        # a part whose forest held has nothing left to join; only those with an edge that failed, with links that were
        # not given yet, or with blocks not yet compared with each other, are compared anew
        given = pairs.where("key IS NOT NULL")
        again = given.join(no, ["a", "b"], "left_semi").select("key").unionAll(given.where("more").select("key"))
        if large and label is None:
            again = again.unionAll(many.where(F.col("g") > BLOCK).select("key"))
        again = scratch.written(again.distinct(), "again")
        many = many.join(again, "key", "left_semi") if many is not None and not again.isEmpty() else None
        if label is None or not yes.isEmpty():
            label = scratch.written(components(linked), "labels")
    else:
        raise RuntimeError("links were left after the last round")
    sizes = table.select("doc", "n").distinct()
    out = marks.select("doc").join(copies, "doc", "left").withColumn("class", F.coalesce("class", "doc")).join(sizes.withColumnRenamed("doc", "class"), "class", "left")
    if label is None:
        label = spark.createDataFrame([], "id long, component long")
    out = out.join(label.withColumnRenamed("id", "class"), "class", "left")
    if count:
        out = out.join(scratch.written(degrees(label, sizes, docs, rule), "degrees"), "class", "left").fillna(0, ["n_linked"])
    else:
        out = out.withColumn("n_linked", F.lit(None).cast("long"))
    # a class without shingles is nobody's copy
    own = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("component", "class"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), own.alias("component_id"), "n_linked")


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """docs without the documents that link, directly or through others, to one with a smaller doc_id."""
    gone = link(docs, rule, count=False).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("doc"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = only(docs.select(row, F.col("doc_id").cast("long").alias("doc")), gone, "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
