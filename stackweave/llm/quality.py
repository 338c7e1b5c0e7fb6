"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of up to WORDS words. Each passage is encoded by a small learned layer over
surface statistics (shares of byte classes, word lengths, repetition, word endings). Gated attention, learned
from document labels alone, weighs the passages: a_k ~ exp(u . (tanh(V h_k) * sigmoid(G h_k))); the weighted
representation sum(a_k h_k) goes to a logistic output.

Null and empty texts are one passage of zeros and get the score of that. Repeated rows get the same score each.
Without labelled rows of both classes all scores are near the share of label 1 (0.5 without labels). Of passages
that the attention weighs alike the first is the top one. Very long texts are read whole: more passages, same memory
for each piece. An empty table gives no rows. Columns of docs pass through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .learning import labelled_sample, segment_sum, sigmoid

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
WORDS = 64
HIDDEN, GATES = 24, 12
#: Byte classes: 0 others, 1 a-z, 2 A-Z, 3 digits, 4 space, 5 line end, 6 . , ; : ? ' -, 7 !, 8 other ASCII marks, 9 non-ASCII
CLASSES = 10
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:] = 1, 2, 3, 4, 5, 9
CLASS[33:48], CLASS[58:65], CLASS[91:97], CLASS[123:127] = 8, 8, 8, 8
CLASS[list(b".,;:?'-")], CLASS[33] = 6, 7
FEATURES = CLASSES + 10


def passages(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each passage, and the first passage of each document."""
    start, end, word, first = X.words(buf, at)
    count = np.diff(first)
    n_pass = np.maximum(1, -(-count // WORDS))
    first_pass = np.concatenate([[0], np.cumsum(n_pass)])
    n = int(first_pass[-1])
    out = np.zeros((n, FEATURES))
    if not len(start):
        return out, first_pass
    doc = np.repeat(np.arange(len(count)), count)
    own = first_pass[doc] + (np.arange(len(start)) - first[doc]) // WORDS
    opens = np.flatnonzero(np.diff(own, prepend=-1))
    ids = own[opens]
    p_start, p_end = start[opens], end[np.append(opens[1:], len(start)) - 1]
    # bytes between passages count for none; one bincount gives all classes
    lens = p_end - p_start
    which = np.repeat(np.arange(len(opens)), lens)
    hist = np.bincount(which * CLASSES + CLASS[buf[X.ragged(p_start, lens)]], minlength=len(opens) * CLASSES).reshape(-1, CLASSES)
    n_words = np.diff(np.append(opens, len(start)))
    length = (end - start).astype(float)
    total = lambda x: np.add.reduceat(x.astype(float), opens) / n_words
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    again = np.zeros(len(word), bool)
    order = np.lexsort((word, own))
    again[1:] = (word[order][1:] == word[order][:-1]) & (own[order][1:] == own[order][:-1])
    last, head = buf[end - 1], buf[start]
    f = out[ids]
    f[:, :CLASSES] = hist / np.maximum(1, lens)[:, None]
    f[:, CLASSES] = total(length) / 10
    f[:, CLASSES + 1] = np.sqrt(np.maximum(0, total(length**2) - total(length) ** 2)) / 10
    f[:, CLASSES + 2] = total(same)
    f[:, CLASSES + 3] = np.add.reduceat(again.astype(float), opens) / n_words  # order is stable within a passage
    f[:, CLASSES + 4] = total(CLASS[last] == 8)
    f[:, CLASSES + 5] = total(CLASS[last] == 7)
    f[:, CLASSES + 6] = total((length == 1) & (CLASS[head] == 8))
    f[:, CLASSES + 7] = total(CLASS[head] == 2)
    f[:, CLASSES + 8] = total(CLASS[last] == 6)
    f[:, CLASSES + 9] = np.log1p(n_words) / np.log(WORDS + 1)
    out[ids] = f
    return out, first_pass


def softmax(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per segment; no segment is empty."""
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), np.diff(at)))
    return e / np.repeat(np.add.reduceat(e, at[:-1]), np.diff(at))


@dataclass
class GatedAttention:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["G"])
        a = softmax((t * s) @ w["u"], at)
        z = segment_sum(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": sigmoid(z @ w["c"] + w["b"][0])}

    def step(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        w, f = self.w, self.forward(x, at)
        d = (f["p"] - y) / len(y)
        doc = np.repeat(np.arange(len(y)), np.diff(at))
        dz = d[:, None] * w["c"]
        da = np.einsum("ij,ij->i", f["h"], dz[doc])
        de = f["a"] * (da - segment_sum(f["a"] * da, at)[doc])
        dts = de[:, None] * w["u"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[doc] + dt @ w["V"].T + ds @ w["G"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ d, "b": d.sum(keepdims=True), "u": (f["t"] * f["s"]).T @ de, "V": f["h"].T @ dt, "G": f["h"].T @ ds, "E": f["x"].T @ dx, "e": dx.sum(0)}


def features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, at in X.pieces(batches, "text"):
        f, first = passages(buf, at)
        yield pa.RecordBatch.from_arrays([part.column("label"), X.list_rows(f.astype(np.float32).ravel(), first[1:] * FEATURES)], ["label", "f"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, epochs: int = 30, seed: int = 5) -> GatedAttention:
    """Fit on at most ``sample`` labelled documents; their passages' statistics come to the driver, not the texts."""
    got = labelled_sample(docs, labels, label, sample).mapInArrow(features_of, "label int, f array<float>").toArrow()
    rng = np.random.default_rng(seed)
    g = lambda *n: rng.normal(0, n[0] ** -0.5, n)
    w = {"E": g(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": g(HIDDEN, GATES), "G": g(HIDDEN, GATES), "u": g(GATES), "c": g(HIDDEN), "b": np.zeros(1)}
    y = got["label"].to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y) or not 0 < y.mean() < 1:
        w["c"][:] = 0
        w["b"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0
        return GatedAttention(np.zeros(FEATURES), np.ones(FEATURES), w)
    f = got["f"].combine_chunks()
    at = np.concatenate([[0], np.cumsum(f.value_lengths().to_numpy())]) // FEATURES
    x = f.flatten().to_numpy().reshape(-1, FEATURES).astype(float)
    m = GatedAttention(x.mean(0), x.std(0) + 1e-3, w)
    first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 128):
            part = order[i : i + 128]
            lens = np.diff(at)[part]
            grad, t = m.step(x[X.ragged(at[part], lens)], np.concatenate([[0], np.cumsum(lens)]), y[part]), t + 1
            for k, d in grad.items():
                d = d + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] -= 4e-3 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m


ADDED = {"quality_score": "double", "n_passages": "int", "top_passage": "int", "top_attention": "double"}


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """docs with quality_score (0 to 1), n_passages, and the passage that the attention weighs most.

    A clashing column of docs is replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in X.pieces(batches, "text"):
            x, first = passages(buf, at)
            f = shared.value.forward(x, first)
            top = np.lexsort((-f["a"], np.repeat(np.arange(part.num_rows), np.diff(first))))[first[:-1]]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(f["p"]), pa.array(np.diff(first).astype(np.int32)), pa.array((top - first[:-1]).astype(np.int32)), pa.array(f["a"][top])], [*keep, *ADDED])

    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"{c} {t}" for c, t in ADDED.items()]
    return docs.select(*keep).mapInArrow(run, ", ".join(fields))
