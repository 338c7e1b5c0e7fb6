"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model on hashed features of a sentence's words gives the probability
that the sentence is toxic; a document is toxic if at least one of its sentences is (noisy-or):
1 - prod(1 - p). Only documents have labels, so the sentences' weights are learned through the noisy-or. The same
sentence scores then say where the offence is.

Null and empty texts count as one empty sentence and get a score from the bias alone. Repeated rows get the same
score each. Without labelled rows of both classes nothing can be learned: all documents get the share of label 1 (0.5
without labels), no sentence is offensive, and filter_toxic() keeps every document. Of sentences that score alike the
first is the worst. Very long texts are scored whole, all sentences. An empty table gives no rows. Columns of docs
pass through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as X
from .learning import labelled_sample, segment_sum, sigmoid

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
BITS = 18
#: Bytes of text whose features a worker holds at once.
PIECE = 1 << 20
#: Lengths in bytes of the word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
OFFENDING = 0.5
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: Standard errors by which a feature's share of label 1 must exceed the mean to count.
STANDS_OUT = 4.0


@dataclass
class Bags:
    """Sentences of a piece: features, the sentence of each, byte spans, and the first sentence of each document."""

    feature: np.ndarray
    sentence: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def bags(buf: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> Bags:
    """Sentences end after . ! ? before white space, and at line ends. Features: words and their first bytes.

    With ``known``, only features for which it holds are listed.
    """
    n_docs = len(at) - 1
    start, end = X.edges(X.LETTER[buf], at)
    first = np.searchsorted(start, at)
    total = X.running(X.LOWER[buf])
    parts = [X.spans_hash(total, start, end)] + [X.spans_hash(total, start, np.minimum(end, start + n)) ^ X.mix(np.array([n]))[0] for n in STEMS]
    stops = np.zeros(len(buf) + 1, np.int64)
    stop = STOP[buf]
    stop[:-1] &= ~X.NOT_SPACE[buf[1:]]
    stop |= buf == 10
    np.cumsum(stop, out=stops[1:])
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    new = np.ones(len(start), bool)
    if len(start):
        new[1:] = (stops[start[1:]] != stops[start[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(start)) - 1 if len(opens) else opens
    first_sentence = np.searchsorted(opens, first)
    # a document without words has one empty sentence
    empty = np.flatnonzero(count == 0)
    where = first_sentence[empty]
    s_start, s_end = np.insert(start[opens], where, at[empty]), np.insert(end[closes], where, at[empty])
    shift = np.zeros(len(opens) + 1, np.int64)
    np.add.at(shift, where, 1)
    sentence = sentence + np.cumsum(shift)[sentence] if len(sentence) else sentence
    first_sentence = first_sentence + np.concatenate([[0], np.cumsum(count == 0)])
    mask = np.uint64((1 << BITS) - 1)
    feature = np.concatenate([(x & mask).astype(np.int32) for x in parts])
    sentence = np.tile(sentence, len(parts))
    if known is not None:
        use = np.flatnonzero(known[feature])
        feature, sentence = feature[use], sentence[use]
    return Bags(feature, sentence, s_start, s_end, first_sentence)


@dataclass
class NoisyOr:
    weight: np.ndarray
    bias: float
    #: The score of all documents where nothing could be learned.
    constant: float | None = None

    def sentences(self, b: Bags) -> np.ndarray:
        n = int(b.first[-1])
        if self.constant is not None:
            return np.zeros(n)
        return sigmoid(np.bincount(b.sentence, self.weight[b.feature], minlength=n) + self.bias) if n else np.zeros(0)

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return -np.expm1(segment_sum(np.log1p(-np.minimum(p, 1 - 1e-12)), first))


def counts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that have it, those of label 1) of a task's labelled documents."""
    n, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for part, buf, at in X.pieces(batches, "text", PIECE):
        b = bags(buf, at)
        doc = np.searchsorted(b.first, b.sentence, "right") - 1
        pair = np.unique(doc.astype(np.int64) << BITS | b.feature)
        f = pair & ((1 << BITS) - 1)
        n += np.bincount(f, minlength=1 << BITS)
        hits += np.bincount(f, part.column("label").to_numpy()[pair >> BITS], minlength=1 << BITS)
    own = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(hits[own].astype(np.int64))], ["feature", "n", "hits"])


def telling(sample: DataFrame, share: float) -> np.ndarray:
    """Features whose share of label 1 stands out; others only fit noise. 2 ** BITS rows at most come to the driver."""
    got = sample.mapInArrow(counts_of, "feature int, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()
    n, hits = got["n"].to_numpy(), got["hits"].to_numpy()
    z = (hits - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    known = np.zeros(1 << BITS, bool)
    known[got["feature"].to_numpy()[(n >= 4) & (z > STANDS_OUT)]] = True
    return known


def distinct(b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature): each feature of a sentence once, sentences in order."""
    pair = np.unique(b.sentence.astype(np.int64) << BITS | b.feature)
    return pair >> BITS, (pair & ((1 << BITS) - 1)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, epochs: int = 12, seed: int = 7) -> NoisyOr:
    """Fit on at most ``sample`` labelled documents; only their telling features come to the driver."""
    rows = scratch.written(labelled_sample(docs, labels, label, sample), "labelled")
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < hits < n:
        return NoisyOr(np.zeros(1 << BITS), 0.0, float(hits / n) if n else 0.5)
    known = telling(rows, hits / n)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in X.pieces(batches, "text", PIECE):
            b = bags(buf, at, shared.value)
            s, f = distinct(b)
            ends = np.searchsorted(s, b.first[1:])
            doc = np.repeat(np.arange(len(at) - 1), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), X.list_rows(f, ends), X.list_rows((s - b.first[doc]).astype(np.int32), ends), pa.array(np.diff(b.first).astype(np.int32))],
                ["label", "feature", "sentence", "n"],
            )

    got = rows.mapInArrow(features_of, "label int, feature array<int>, sentence array<int>, n int").toArrow()
    y = got["label"].to_numpy().astype(float)
    flat, sent = (got[c].combine_chunks().flatten().to_numpy() for c in ("feature", "sentence"))
    ends = np.concatenate([[0], np.cumsum(got["feature"].combine_chunks().value_lengths().to_numpy())])
    count = got["n"].to_numpy().astype(np.int64)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(1 << BITS), -5.0
    gw, gb = np.full(1 << BITS, 1e-3), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 128):
            part = order[i : i + 128]
            take = X.ragged(ends[part], (ends[1:] - ends[:-1])[part])
            f, lens = flat[take], (ends[1:] - ends[:-1])[part]
            first = np.concatenate([[0], np.cumsum(count[part])])
            s = sent[take] + np.repeat(first[:-1], lens)
            p = sigmoid(np.bincount(s, w[f], minlength=first[-1]) + b)
            P = np.clip(-np.expm1(segment_sum(np.log1p(-np.minimum(p, 1 - 1e-12)), first)), 1e-9, 1 - 1e-9)
            t = y[part]
            # d loss / d s: p for label 0, -p (1 - P) / P for label 1
            g = np.repeat(np.where(t > 0, -(1 - P) / P, 1.0), count[part]) * p / len(part)
            dw = np.bincount(f, g[s], minlength=1 << BITS)
            touched = np.flatnonzero(dw)
            d = dw[touched] + 1e-5 * w[touched]
            gw[touched] += d * d
            w[touched] -= 0.5 * d / np.sqrt(gw[touched])
            d = g.sum()
            gb += d * d
            b -= 0.1 * d / np.sqrt(gb)
    return NoisyOr(w, float(b))


def score(docs: DataFrame, model: NoisyOr, offending: float = OFFENDING) -> DataFrame:
    """docs with toxic_score, the number of sentences, the worst one, and those with p >= offending.

    Places are bytes: worst_start, worst_end, and offending array<struct<start, end, score>>. A clashing column of docs
    is replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = m.weight != 0
        for part, buf, at in X.pieces(batches, "text", PIECE):
            b = bags(buf, at, known)
            # each feature of a sentence counts once, as in fit()
            b.sentence, b.feature = distinct(b)
            p = m.sentences(b)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(b.first))
            order = np.lexsort((-p, doc))
            worst = order[b.first[:-1]]
            bad = np.flatnonzero(p >= offending)
            ends = np.searchsorted(doc[bad], np.arange(len(at) - 1), "right")
            spans = pa.StructArray.from_arrays([pa.array((x[bad] - at[doc[bad]]).astype(np.int32)) for x in (b.start, b.end)] + [pa.array(p[bad])], ["start", "end", "score"])
            offends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep]
                + [pa.array(m.documents(p, b.first)), pa.array(np.diff(b.first).astype(np.int32))]
                + [pa.array((x[worst] - at[:-1]).astype(np.int32)) for x in (b.start, b.end)]
                + [pa.array(p[worst]), offends],
                [*keep, *ADDED],
            )

    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"{c} {t}" for c, t in ADDED.items()]
    return docs.select(*keep).mapInArrow(run, ", ".join(fields))


ADDED = {"toxic_score": "double", "n_sentences": "int", "worst_start": "int", "worst_end": "int", "worst_score": "double", "offending": "array<struct<start:int,end:int,score:double>>"}


def filter_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The documents with a score under ``threshold``, with the columns they had; all, where nothing could be learned."""
    if model.constant is not None:
        return docs
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    out = score(docs.select("text", rest), model).where(F.col("toxic_score") < threshold)
    return out.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
