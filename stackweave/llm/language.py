"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is cut into windows: a word with a space before and after it, in runs of at most WINDOW bytes where it is longer.
A gated recurrent layer reads each window's bytes forwards, another backwards; from both states a softmax labels every
position with the probability of each language. A document's probabilities are the means over its positions within
words (bytes of letters, ASCII or not); the language of the largest mean is predicted (ties: the first in alphabetical
order), with that mean as score. The network is fitted by backpropagation through time in numpy, on windows of labelled
documents: every position of a window learns the document's language. Windows that occur again in a piece of text are
read once and counted.

Null texts and texts without a letter get "und" and score 0; so do all texts where no labelled row has a letter. Very
long texts are read whole, piece by piece of the column. Repeated rows get the same language each. Labelled rows with a
null language, text or id are not learned from. An empty table gives no rows. Columns of docs pass through; those named
like a result, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as X
from .learning import LONGEST, segment_sum

#: Labelled documents that the network is fitted on, at most (shared evenly by the languages), and windows of each.
SAMPLE, WINDOWS = 4_000, 32
#: Bytes of a window, without the spaces around it.
WINDOW = 24
HIDDEN = 12
#: Windows that go through the network at once: their states fit the cache.
TOGETHER = 2048
#: Steps of the fit, windows of a step, first step size.
STEPS, BATCH, RATE = 200, 2048, 0.02
#: Bytes of labelled windows that a worker keeps.
KEPT = 32 << 20
UNKNOWN = "und"
ADDED = {"lang_pred": "string", "score": "double"}


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 by 4: these rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Windows:
    """Windows in order of falling length: their bytes by position (0 after the end), lengths, which positions count."""

    byte: np.ndarray
    length: np.ndarray
    letter: np.ndarray


def spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all windows that hold a letter."""
    start, end = X.edges(X.NOT_SPACE[buf], at)
    runs = -(-(end - start) // WINDOW)  # a longer word in runs of WINDOW bytes
    begin = np.repeat(start, runs) + (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)) * WINDOW
    stop = np.minimum(begin + WINDOW, np.repeat(end, runs))
    letters = np.concatenate([[0], np.cumsum(LETTERS[buf])])
    some = letters[stop] > letters[begin]
    begin, stop = begin[some], stop[some]
    return begin, stop, np.searchsorted(at, begin, "right") - 1


def windows(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Windows:
    """The bytes [begin, stop), which are in order of falling length, with a space at both ends."""
    length = stop - begin
    byte = np.zeros((int(length.max(initial=0)) + 2, len(begin)), np.uint8)
    byte[0] = 32
    byte[X.ragged(np.ones(len(begin), np.int64), length), np.repeat(np.arange(len(begin)), length)] = buf[X.ragged(begin, length)]
    byte[length + 1, np.arange(len(begin))] = 32
    return Windows(byte, length + 2, LETTERS[byte])


LETTERS = X.LETTER.copy()
LETTERS[48:58] = False


def gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """(new state, update, reset, candidate, the candidate's recurrent part) from inputs x of all three gates."""
    k = h.shape[1]
    rec = h @ u
    zr = np.tanh((x[:, : 2 * k] + rec[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r, back = zr[:, :k], zr[:, k:], rec[:, 2 * k :]
    c = np.tanh(x[:, 2 * k :] + r * back)
    return c + z * (h - c), z, r, c, back


@dataclass
class Network:
    """Weights: inputs of a byte (W) and of the state (U) for either direction, and the output layer (C, c)."""

    langs: list[str]
    w: dict[str, np.ndarray]

    def states(self, wins: Windows, keep: bool = False) -> tuple[list[np.ndarray], list[list[tuple]]]:
        """States of both directions at every position; windows are in order of falling length, so those alive are the first ones."""
        out, saved = [], []
        alive = np.searchsorted(-wins.length, -np.arange(len(wins.byte)), "left")  # windows longer than t
        for way in "fb":
            w, u = self.w["W" + way], self.w["U" + way]
            h = np.zeros((len(wins.length), u.shape[0]), np.float32)
            states = np.zeros((*wins.byte.shape, u.shape[0]), np.float32)
            steps = []
            for t in range(len(wins.byte)):
                n = alive[t]
                if not n:
                    break
                at = np.full(n, t) if way == "f" else wins.length[:n] - 1 - t
                byte = wins.byte[t, :n] if way == "f" else wins.byte[at, np.arange(n)]
                before = h[:n]
                now, *rest = gates(w[byte], before, u)
                if keep:
                    steps.append((n, at, byte, before.copy(), *rest))
                h[:n] = now
                if way == "f":
                    states[t, :n] = now
                else:
                    states[at, np.arange(n)] = now
            out.append(states)
            saved.append(steps)
        return out, saved

    def labels(self, buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window [begin, stop), summed over its counted positions."""
        order = np.argsort(begin - stop, kind="stable")
        out = np.zeros((len(begin), len(self.langs)), np.float32)
        for i in range(0, len(order), TOGETHER):
            some = order[i : i + TOGETHER]
            out[some] = self.few_labels(windows(buf, begin[some], stop[some]))
        return out

    def few_labels(self, wins: Windows) -> np.ndarray:
        (f, b), _ = self.states(wins)
        t, i = np.nonzero(wins.letter)
        p = softmax(f[t, i] @ self.w["Cf"] + b[t, i] @ self.w["Cb"] + self.w["c"])
        return np.stack([np.bincount(i, p[:, k], len(wins.length)) for k in range(len(self.langs))], 1)

    def step(self, wins: Windows, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over all counted positions, by backpropagation through time."""
        w = self.w
        (f, b), saved = self.states(wins, keep=True)
        on = wins.letter / max(1, int(wins.letter.sum()))
        p = softmax(f @ w["Cf"] + b @ w["Cb"] + w["c"])
        p[:, np.arange(len(y)), y] -= 1
        d = (p * on[:, :, None]).astype(np.float32)
        grad = {"Cf": np.einsum("tnh,tnl->hl", f, d, optimize=True), "Cb": np.einsum("tnh,tnl->hl", b, d, optimize=True), "c": d.sum((0, 1))}
        for way, steps in zip("fb", saved):
            u, k = w["U" + way], w["U" + way].shape[0]
            gw, gu = np.zeros_like(w["W" + way]), np.zeros_like(u)
            above = d @ w["C" + way].T
            carry = np.zeros((len(y), k), np.float32)
            for n, at, byte, before, z, r, c, back in reversed(steps):
                dh = carry[:n] + above[at, np.arange(n)]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = dc * back * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], 1)
                drec = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(gw, byte, dx)
                gu += before.T @ drec
                carry[:n] = dh * z + drec @ u.T
            grad["W" + way], grad["U" + way] = gw, gu
        return grad


def softmax(e: np.ndarray) -> np.ndarray:
    e = np.exp(e - e.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def started(langs: list[str], seed: int = 11, hidden: int = HIDDEN) -> Network:
    rng = np.random.default_rng(seed)
    g = lambda scale, *n: rng.normal(0, scale, n).astype(np.float32)
    w = {}
    for way in "fb":
        w["W" + way], w["U" + way], w["C" + way] = g(0.3, 256, 3 * hidden), g(hidden**-0.5, hidden, 3 * hidden), g(hidden**-0.5, hidden, len(langs))
    return Network(langs, w | {"c": np.zeros(len(langs), np.float32)})


class Seen:
    """What the network said about windows, for a worker's next pieces: as many as KEPT bytes hold, sorted by hash."""

    def __init__(self, network: Network) -> None:
        self.network, self.limit = network, KEPT // (8 + 4 * len(network.langs))
        self.hash, self.label = np.zeros(0, np.uint64), np.zeros((0, len(network.langs)), np.float32)

    def labels(self, buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h, first, of = np.unique(X.spans_hash(X.running(buf), begin, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, h)
        old = np.zeros(len(h), bool)
        old[place < len(self.hash)] = self.hash[place[place < len(self.hash)]] == h[place < len(self.hash)]
        label = np.empty((len(h), len(self.network.langs)), np.float32)
        label[old] = self.label[place[old]]
        new = np.flatnonzero(~old)
        label[new] = self.network.labels(buf, begin[first[new]], stop[first[new]])
        if len(self.hash) + len(new) > self.limit:
            self.hash, self.label = h[: self.limit], label[: self.limit]
        else:
            self.hash, self.label = np.insert(self.hash, place[new], h[new]), np.insert(self.label, place[new], label[new], axis=0)
        return label[of]


def sample(docs: DataFrame, bound: int, each: int) -> DataFrame:
    """(lang, window): of ``bound`` labelled documents at most, as many of each language, ``each`` windows evenly spread.

    Of a language the rows with the smallest hash of the id are taken, so that the choice is the same in every run. Rows
    whose hash is too large for that, by the language's count, go before any is shuffled.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST))
    counts = scratch.written(rows.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    n = max(1, bound // max(1, counts.count()))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    near = rows.join(counts, "lang").where(share * F.col("of") <= 1.2 * n + 50)
    order = Window.partitionBy("lang").orderBy(share, "doc_id", F.xxhash64("text"))
    some = near.select("lang", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in X.pieces(batches, "text"):
            begin, stop, doc = spans(buf, at)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            take = np.concatenate([np.unique(np.linspace(a, b - 1, min(each, b - a)).astype(np.int64)) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)])
            data = buf.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(doc[take])), pa.array([data[i:j] for i, j in zip(begin[take].tolist(), stop[take].tolist())], pa.binary())], ["lang", "window"])

    return some.select("lang", "text").mapInArrow(run, "lang string, window binary")


def fit(docs: DataFrame, bound: int = SAMPLE, each: int = WINDOWS, steps: int = STEPS, seed: int = 11) -> Network:
    """Fit on at most ``bound`` labelled documents, of which at most ``each`` windows come to the driver."""
    with scratch.temporary(docs.sparkSession):
        got = sample(docs.select("doc_id", "text", "lang"), bound, each).toArrow()
    if not got.num_rows:
        return started([])
    lang = got["lang"].to_numpy()
    langs = sorted(set(lang))
    y = np.searchsorted(np.array(langs, object), lang)
    text = got["window"].cast(pa.large_binary()).combine_chunks()
    stop = np.cumsum([len(x) for x in text.to_pylist()])
    begin, buf = np.concatenate([[0], stop[:-1]]), np.frombuffer(b"".join(text.to_pylist()), np.uint8)
    net, rng = started(langs, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    share = np.bincount(y, minlength=len(langs))
    for i in range(steps):
        # as many windows of each language, however many it has
        some = rng.choice(len(y), BATCH, p=1 / (len(langs) * share[y]))
        some = some[np.argsort(begin[some] - stop[some], kind="stable")]
        for k, g in net.step(windows(buf, begin[some], stop[some]), y[some]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.w[k] -= np.float32(RATE * (1 - i / steps)) * (first[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (i + 1))) + np.float32(1e-8))
    return net


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """docs with lang_pred and score."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    named = {c: f"c{i}" for i, c in enumerate(keep)}
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some ten thousand weights and a few a language
    given = docs.select(F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("any"), *(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    fields = [f"{n} {t}" for n, t in given.drop("text", "any").dtypes] + [f"{c} {t}" for c, t in ADDED.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        seen, langs = Seen(net), np.array([*net.langs, UNKNOWN], object)
        for part, buf, at in X.pieces(batches, "text"):
            any_letter = part.column(1).to_numpy(zero_copy_only=False)
            best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
            begin, stop, doc = spans(buf, at)
            if net.langs and len(begin):
                label = seen.labels(buf, begin, stop)
                total = segment_sum(label.astype(np.float64), np.searchsorted(doc, np.arange(part.num_rows + 1)))
                known = np.flatnonzero(any_letter & (total.sum(1) > 0))
                best[known] = total[known].argmax(1)
                score[known] = total[known].max(1) / total[known].sum(1)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(langs[best], pa.string()), pa.array(score)], [*named.values(), *ADDED])

    out = given.mapInArrow(run, ", ".join(fields))
    return out.select(*(F.col(n).alias(c) for c, n in named.items()), *ADDED)
