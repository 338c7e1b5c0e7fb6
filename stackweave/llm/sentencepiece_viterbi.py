"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The model file's pieces and scores are taken as a unigram model: a text's encoding is the sequence of pieces with
the largest sum of scores; among equal sums the one whose last pieces are longest. As the model asks for, a space
is put before the text, spaces are written as U+2581, and characters without a piece become their bytes' pieces.
No piece has a space after another character, so that a text is cut before spaces and its units are independent.
All distinct units of one length advance together: substring hashes probe the sorted hashes of the pieces, and
maxima over the start of the last piece are stored as backpointers.

A model file trained for merges (BPE) has scores by rank; its own merge order is another rule, whose result may
split a word otherwise. The sum of its ranks is maximised here, as the method asks for; decoding gives the
text back either way.

Null and empty texts have no ids and decode to the empty text. A U+2581 in a text decodes to a space. Repeated
rows are encoded each. Very long texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as X
from .units import Encoded, starts

SPACE = "▁".encode()
#: The penalty, below the least score, of a character without a piece.
UNKNOWN = 10.0
_kept: dict[str, "Pieces"] = {}
#: Bytes of matrices that one step may take.
STEP = 8 << 20
#: Units that a worker keeps the ids of.
KEPT = 200_000


@dataclass
class Pieces:
    keys: np.ndarray  # sorted hashes
    ids: np.ndarray  # by key
    scores: np.ndarray  # by key
    filter: np.ndarray  # bit set of hashes' low bits: most substrings are no piece
    longest: int
    byte_ids: np.ndarray
    unknown: float
    prefix: bool
    flat: np.ndarray  # what each id decodes to
    begin: np.ndarray
    length: np.ndarray
    encoded: Encoded

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with spaces before words, can be used")
        self.prefix = spec.add_dummy_prefix
        text, ids, scores, out = [], [], [], []
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            raw = p.piece.encode()
            out.append(raw.replace(SPACE, b" "))
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                out[-1] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (1, 4):  # normal or user-defined
                if SPACE in raw.lstrip(SPACE[:0]).removeprefix(SPACE) and raw.replace(SPACE, b""):
                    raise ValueError("a piece has a space after another character")
                text.append(raw.replace(SPACE, b" "))
                ids.append(i)
                scores.append(p.score)
            elif p.type in (2, 3, 5):
                out[-1] = b""
        self.unknown = min(scores) - UNKNOWN
        self.longest = max(map(len, text))
        buf = np.frombuffer(b"".join(text), np.uint8)
        end = np.cumsum([len(x) for x in text])
        keys = X.spans_hash(X.running(buf), end - [len(x) for x in text], end)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids, np.int32)[order], np.array(scores)[order]
        self.filter = np.zeros(1 << 21, bool)
        self.filter[(keys & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.length = np.array([len(x) for x in out], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.encoded = Encoded(self.encode, KEPT)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score or -inf, id) of each hash."""
        score, ids = np.full(keys.shape, -np.inf), np.full(keys.shape, -1, np.int32)
        maybe = np.nonzero(self.filter[(keys & np.uint64((1 << 21) - 1)).astype(np.int64)])
        k = keys[maybe]
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[i] == k
        where = tuple(x[hit] for x in maybe)
        score[where], ids[where] = self.scores[i[hit]], self.ids[i[hit]]
        return score, ids

    def same_length(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (rows of bytes), and how many each has."""
        n, L = w.shape
        up, down = X.powers(L + 2)
        total = np.zeros((n, L + 1), np.uint64)
        np.cumsum((w.astype(np.uint64) + np.uint64(1)) * up[:L], axis=1, out=total[:, 1:])
        lead = (w & 0xC0) != 0x80  # begins a character
        # bytes of the character that ends at each place
        since = np.arange(L) - np.maximum.accumulate(np.where(lead, np.arange(L), 0), axis=1) + 1
        best = np.full((n, L + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, L + 1), np.int32), np.zeros((n, L + 1), np.int32)
        for e in range(1, L + 1):
            s = np.arange(max(0, e - self.longest), e)  # the longest last piece first: argmax takes the first
            keys = X.mix((total[:, e : e + 1] - total[:, s]) * down[s] + (e - s).astype(np.uint64))
            score, ids = self.probe(keys)
            score += best[:, s]
            top = np.argmax(score, axis=1)
            rows = np.arange(n)
            best[:, e], piece[:, e], back[:, e] = score[rows, top], ids[rows, top], s[top]
            ends = lead[:, e] if e < L else np.ones(n, bool)
            start = e - since[:, e - 1]
            unknown = best[rows, start] + self.unknown
            better = ends & (unknown > best[:, e])
            best[better, e], piece[better, e], back[better, e] = unknown[better], -1, start[better]
        # walk back together; bytes of unknown characters are listed singly
        out, at, rows, count = np.zeros((n, L), np.int32), np.full(n, L), np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            e = at[rows]
            p, s = piece[rows, e], back[rows, e]
            known = p >= 0
            r = rows[known]
            count[r] += 1
            out[r, L - count[r]] = p[known]
            for k in np.unique((e - s)[~known]).tolist():
                r = rows[~known & (e - s == k)]
                for j in range(k):
                    count[r] += 1
                    out[r, L - count[r]] = self.byte_ids[w[r, at[r] - 1 - j]]
            at[rows] = s
            rows = rows[s > 0]
        return out[np.arange(L) >= (L - count)[:, None]], count

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(u) for u in units])
        flat, at = np.frombuffer(b"".join(units), np.uint8), np.cumsum(length) - length
        count, got = np.zeros(len(units), np.int64), []
        for L in np.unique(length).tolist():
            own = np.flatnonzero(length == L)
            rows = max(1, STEP // (8 * (L + 1) * 4))
            for i in range(0, len(own), rows):
                part = own[i : i + rows]
                ids, n = self.same_length(flat[at[part][:, None] + np.arange(L)])
                count[part] = n
                got.append((part, ids))
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for part, ids in got:
            out[X.ragged(begin[part], count[part])] = ids
        return out, count.astype(np.int32)

    def encode_texts(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, end of each)"""
        if self.prefix:
            has = np.diff(at) > 0
            buf = np.insert(buf, at[:-1][has], 32)
            at = at + np.concatenate([[0], np.cumsum(has)])
        return self.encoded.documents(buf, at, starts(buf, at, only_space=True))

    def decode_texts(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all documents, end of each)"""
        length = self.length[flat]
        out = self.flat[X.ragged(self.begin[flat], length)]
        stop = np.concatenate([[0], np.cumsum(length)])[ends]
        if self.prefix:
            start = np.concatenate([[0], stop[:-1]])
            has = stop > start
            out = np.delete(out, start[has])
            stop = stop - np.cumsum(has)
        return out, stop


def pieces(path: str) -> Pieces:
    """The worker's model of a file."""
    if path not in _kept:
        _kept[path] = Pieces(path)
    return _kept[path]


def _others(rows: DataFrame, *added: str) -> list[str]:
    """The columns that no result replaces; Spark's names are the same in capitals and small letters."""
    return [c for c in rows.columns if c.lower() not in {name.lower() for name in added}]


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """docs with the array of the text's ids in ``column``.

    Null and empty texts have no ids, an empty table no rows; rows that repeat a doc_id or a text are encoded each. A
    column of docs with the name of the result, in letters of either case, is replaced by it.
    """
    keep = _others(docs, column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in X.pieces(batches, "text"):
            flat, ends = pieces(path).encode_texts(buf, at)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), X.list_rows(flat, ends)], [*keep, column])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"`{column}` array<int>"]))


def round_trip(docs: DataFrame, path: str, column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of the ids in one pass, with one worker a task; clashing columns are replaced as there."""
    keep = _others(docs, column, decoded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in X.pieces(batches, "text"):
            flat, ends = pieces(path).encode_texts(buf, at)
            raw, stop = pieces(path).decode_texts(flat, ends)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), X.list_rows(flat, ends), X.binary_rows(raw, stop).cast(pa.string())], [*keep, column, decoded])

    return docs.select(*keep).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"`{column}` array<int>, `{decoded}` string"]))


def decode(rows: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """rows with the text of the array ``ids`` in ``column``; a null array gives the empty text, clashing columns are replaced."""
    keep = _others(rows, column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            lens = lists.value_lengths().fill_null(0).to_numpy()
            flat, stop = pieces(path).decode_texts(lists.flatten().to_numpy(), np.cumsum(lens))
            text = X.binary_rows(flat, stop).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text], [*keep, column])

    return rows.select(*keep).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in rows.select(*keep).dtypes] + [f"`{column}` string"]))
