"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

The index of lines seen so far is a set of runs: Parquet tables of 128-bit line hashes, bucketed and sorted by
hash, in levels. Each new batch of documents merge-anti-joins the runs, all in one join: hashes that none of them
holds are new and become a run of level 0. When a level has FANOUT runs they are merged into one run of the next level,
so that a batch meets few runs and each hash is rewritten a logarithmic number of times. A line that very many
documents hold is not brought together in one task: its documents meet a broadcast of such keys (ids.join_counted). A line of a batch is dropped if
its hash is in a run, or in a document of the batch with a smaller id: of all documents added so far only the
first keeps the line, and keeps all its occurrences there.

Defined results: a null or empty text is one empty line. Lines whose key (ends stripped of \\x20 \\x09-\\x0D,
A-Z lower-cased) has fewer than MIN_CHARS code points always stay. Rows that repeat a doc_id count as one document:
none of them takes lines from the other, and a line is dropped from all of them or from none. Rows with a null doc_id
come after all others, as one document. A line that stands several times in the first document stays there each
time. An empty batch or table changes nothing. Further columns pass through, whatever their names; the three result
columns replace any of the same name. Very long texts are taken whole: a row of the line table holds one line's
hashes. Hashes are two independent 64-bit values, so that chance agreement is no concern at 10 ** 15 lines.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .ids import join_counted

MIN_CHARS = 10
FANOUT = 2
#: Bytes of text whose hashes one bucket of a run holds, and buckets at least and at most.
BUCKET_BYTES, BUCKETS, MOST_BUCKETS = 2 << 30, 24, 65_536
#: Bytes of text of a batch: each one reads all runs, so that batches are few and large.
BATCH_BYTES = 1 << 40
KEY = ["h1", "h2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, pos, h1, h2) of each line that can be dropped: doc is the id, row the text's hash, pos the line's place."""
    keys = F.transform(split_lines(F.col("text")), line_key)
    marked = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("\x00"), k, F.length(k)).alias("h2"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), text_hash(F.col("text")).alias("row"), F.explode(F.array_compact(marked)).alias("l")).select("doc", "row", "l.*")


@dataclass
class LineRuns:
    """The runs of one corpus. add() gives the lines of a batch to drop, and takes the batch's hashes in."""

    spark: SparkSession
    fanout: int = FANOUT
    buckets: int = BUCKETS
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def _write(self, hashes: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        (
            hashes.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", scratch.place(self.spark, table))
            .saveAsTable(table)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, lines: DataFrame, more: bool = True) -> DataFrame:
        """lines: keyed_lines() of documents all added after those in the runs. Returns (doc, row, pos) to drop.

        The batch's keys meet all runs in one join. Without ``more`` nothing follows, and the batch makes no run.
        """
        first = lines.groupBy(*KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), (F.count("*") > F.count("doc")).alias("null_id"), F.count("*").alias("n"))
        old = F.lit(False)
        if self.runs():
            seen = reduce(DataFrame.unionAll, [self.spark.table(t).select(*KEY) for t in self.runs()])  # runs share no hash
            first, old = first.join(seen.withColumn("seen", F.lit(True)), KEY, "left"), F.col("seen").isNotNull()
        first = scratch.written(first.select(*KEY, "first", "last", "null_id", "n", old.alias("old")), "line-first")
        if more:
            self._write(first.where(~F.col("old")).select(*KEY), 0)
            self._compact()
        # a key of one document that no run holds drops nothing
        some = F.col("first").isNotNull()
        hit = first.where(F.col("old") | (some & ((F.col("last") > F.col("first")) | F.col("null_id"))))
        total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        later = F.col("doc").isNull() | (F.col("doc") > F.col("first"))
        return join_counted(lines, hit, KEY, "n", total, stored=True).where(F.col("old") | (some & later)).select("doc", "row", "pos")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                hashes = self.spark.table(merged[0])
                for t in merged[1:]:
                    hashes = hashes.unionAll(self.spark.table(t))  # runs share no hash
                self._write(hashes, level + 1)
                for t in merged:
                    self._drop(t)
            level += 1

    def _drop(self, table: str) -> None:
        where = self.spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {table}")
        scratch.discard(self.spark, where)

    def close(self) -> None:
        for t in self.runs():
            self._drop(t)
        self.levels = []


ADDED = ("kept_text", "n_lines", "n_dropped")


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped after the lines (doc, row, pos) are taken out."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    whole = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("all")  # so that no name of docs meets one of the join
    at = dropped.groupBy("doc", "row").agg(F.collect_set("pos").alias("dropped")).select(F.col("doc").alias("doc_"), F.col("row").alias("row_"), "dropped")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc"), text_hash(F.col("text")).alias("row"))
    marked = rows.join(at, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("row") == F.col("row_")), "left")
    lines = split_lines(F.col("all.text"))
    none = F.col("dropped").isNull()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    text = F.when(none, F.coalesce("all.text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return marked.select(
        *(F.col("all")[c].alias(c) for c in keep),
        text.alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
    )


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that split the documents into about equal batches, by approximate quantiles of doc_id."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10_000)).first()[0]
    return sorted({int(x) for x in got or []})


def bytes_of(docs: DataFrame) -> int:
    return docs.select(F.octet_length("text").cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def batches_of(n_bytes: int, fanout: int = FANOUT) -> int:
    """Batches of BATCH_BYTES, and so many at least that runs are compacted."""
    return max(fanout + 1, -(-n_bytes // BATCH_BYTES))


def buckets_of(n_bytes: int) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, -(-n_bytes // BUCKET_BYTES)))


LINES = "doc long, row long, pos int, h1 long, h2 long, batch int"


def dedup_lines(docs: DataFrame, batches: int | None = None, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """All documents, taken into new runs in ``batches`` batches of ascending doc_id (None: batches_of()); see without_lines()."""
    spark = docs.sparkSession
    n_bytes = bytes_of(docs)
    bounds = batch_bounds(docs, batches_of(n_bytes, fanout) if batches is None else batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc") > b).cast("int")
    runs = LineRuns(spark, fanout, buckets_of(n_bytes))
    with scratch.temporary(spark) as keep:
        try:
            lines = scratch.place(spark, "lines")
            keyed_lines(docs, min_chars).withColumn("batch", F.coalesce(batch, F.lit(len(bounds)))).write.partitionBy("batch").parquet(lines)
            table = spark.read.schema(LINES).parquet(lines)
            dropped = [keep(runs.add(table.where(F.col("batch") == i).drop("batch"), i < len(bounds)), "line-drops") for i in range(len(bounds) + 1)]
        finally:
            runs.close()
    return without_lines(docs, reduce(DataFrame.unionAll, dropped))


def keep_unique_lines(docs: DataFrame, batches: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with its columns, text without the dropped lines; documents left without a word go.

    Columns that have the names of the results are passed through, too.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = {"doc_id": F.col("doc_id"), "text": F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("text")}
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("rest")
    out = dedup_lines(docs.select("doc_id", "text", rest), batches, min_chars)
    left = F.length(F.btrim(F.col("kept_text"), F.lit(" \t\n\x0b\x0c\r"))) > 0
    return out.where((F.col("n_dropped") == 0) | left).select(*(own[c] if c in own else F.col("rest")[c].alias(c) for c in docs.columns))
