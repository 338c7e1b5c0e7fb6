"""Token ids in Parquet files: list columns, dictionary or delta encoded, in row groups of a set size.

Texts are encoded with a tokenizer file of the tokenizers library; each document gets an end id. Rows are written
in ascending order of doc_id (null first, equal ids by text): file part-i holds a range of ids, so that the row
group and page indexes on doc_id let a reader fetch a few documents, or only the lengths, without the rest.

Columns of a file: doc_id and at (ids of the part before this document), both delta encoded; part and n_tokens;
ids list<int32>, dictionary encoded. A null or empty text is the end id alone. Repeated rows are written each.
Very long texts are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .units import Encoded, starts

SCHEMA = "doc_id long, part int, at long, n_tokens int, ids array<int>"
END_ID = 0
#: Bytes of a row group and of a page before compression.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: New units encoded in one call's text.
JOINED = 1000
#: Bytes of text at a time.
PIECE = 6 << 20
_kept: dict[str, Encoded] = {}


def begins(unit: bytes) -> bool:
    return unit[:1] in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def ends_safely(unit: bytes) -> bool:
    """The last character is one that starts() allows a cut after."""
    return 32 < unit[-1] < 127 or (unit[-1] >= 0x80 and len(unit) > 1 and 0xC3 <= unit[-2] <= 0xDF)


def encoder(path: str) -> Encoded:
    """The worker's encoder for a tokenizer file."""
    if path not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])  # one character of a piece is one byte

        def singly(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """(flat ids, length of each)"""
            ids = [e.ids for e in tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
            return np.concatenate([np.array(x, np.int32) for x in ids] or [np.zeros(0, np.int32)]), np.array([len(x) for x in ids], np.int32)

        def together(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """As singly() for units that can stand next to each other: one text, its ids cut where units end."""
            flat, _ = singly([b"".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)])
            end, place = np.cumsum([len(u) for u in units]), np.cumsum(size[flat])
            cut = np.searchsorted(place, end)
            if len(place) != (cut[-1] + 1 if len(cut) else 0) or not np.array_equal(place[cut], end):
                return singly(units)
            return flat, np.diff(cut, prepend=-1).astype(np.int32)

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain = np.array([begins(u) and ends_safely(u) for u in units], bool)
            length, got = np.zeros(len(units), np.int32), []
            for of, how in ((np.flatnonzero(plain), together), (np.flatnonzero(~plain), singly)):
                flat, n = how([units[i] for i in of.tolist()])
                length[of] = n
                got.append((of, flat))
            begin, out = np.cumsum(length, dtype=np.int64) - length, np.zeros(int(length.sum()), np.int32)
            for of, flat in got:
                out[X.ragged(begin[of], length[of].astype(np.int64))] = flat
            return out, length

        _kept[path] = Encoded(encode)
    return _kept[path]


def encode(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids) of docs as they are partitioned; part is Spark's partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for rows, buf, at in X.pieces(batches, "text", PIECE):
            flat, ends = own.documents(buf, at, starts(buf, at))
            if end_id is not None:
                flat = np.insert(flat, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n.astype(np.int32)), X.list_rows(flat.astype(np.int32), ends)],
                ["doc_id", "part", "at", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, tokenizer: str, out: str, row_group: int = ROW_GROUP, page: int = PAGE, end_id: int | None = END_ID) -> None:
    """Encode docs and write them to the folder ``out`` in ascending order of doc_id."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode(ordered, tokenizer, end_id)
        .write.option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.writer.version", "v2")  # integers without a dictionary are delta encoded
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#at", "false")
        .option("compression", "zstd")
        .parquet(out)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Filters on doc_id and unselected columns are not read."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts_of(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all parts before, from the metadata columns alone; one row per part."""
    per_part = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one small row per file in this window
    return per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def checksums(rows: DataFrame) -> DataFrame:
    """rows of read() with ids_crc32 in place of ids: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "at", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "part", "at", "n_tokens", "ids").mapInArrow(run, "doc_id long, part int, at long, n_tokens int, ids_crc32 long")
