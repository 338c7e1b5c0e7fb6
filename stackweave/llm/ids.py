"""Documents by id: one row per id, those with or without given ids, and classes of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Ids up to which a list of them is broadcast (16 bytes each); a longer list is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A key is hot from so many rows on, and from one in HOT_SHARE of all rows; so there are HOT_SHARE hot keys at most.
HOT, HOT_SHARE = 1_000, 100_000
#: Places that the rows of a hot key are dealt to where its row is too wide for a broadcast.
DEALT = 64


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs with (or, with left_anti, without) the ids: a broadcast if they are few, else a shuffle."""
    ids = scratch.written(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", how)


def one_per_id(docs: DataFrame) -> DataFrame:
    """(doc, text) with the text that sorts first of each repeated id; ids alone are counted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).where("doc IS NOT NULL")
    again = scratch.written(docs.groupBy("doc").count().where("count > 1").select("doc"), "again")
    if again.isEmpty():
        return docs
    return docs.join(again, "doc", "left_anti").unionByName(docs.join(again, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")))


def join_counted(rows: DataFrame, by_key: DataFrame, keys: list[str], n: str, total: int, width: Column | None = None, stored: bool = False) -> DataFrame:
    """rows inner-joined with by_key, which has one row a key, and in ``n`` how many rows have the key.

    Rows of a hot key are not brought together: hot keys, HOT_SHARE of them at most, are broadcast. Where a row of by_key
    has a ``width`` (its elements) and those of hot keys are more than BROADCAST_IDS together, the hot rows are dealt out
    by a hash of theirs instead, and each hot key is sent to DEALT places. stored: by_key is cheap to read again.
    """
    by_key = by_key if stored else scratch.written(by_key, "by-key")
    hot = F.col(n) > max(HOT, total // HOT_SHARE)
    often = by_key.where(hot)
    wide = often.agg(F.sum(F.lit(1) if width is None else width)).first()[0]
    if wide is None:
        return rows.join(by_key, keys)
    names = F.broadcast(often.select(*keys))
    rest = rows.join(names, keys, "left_anti").join(by_key.where(~hot), keys)
    if wide <= BROADCAST_IDS:
        return rows.join(F.broadcast(often), keys).unionByName(rest)
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(DEALT)).cast("int")
    dealt = often.withColumn("dealt_to", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    most = rows.join(names, keys, "left_semi").withColumn("dealt_to", place).join(dealt.hint("shuffle_hash"), [*keys, "dealt_to"]).drop("dealt_to")
    return most.unionByName(rest)


def copies_of(marks: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(columns of marks, class): rows (doc, keys) that agree in the keys with one of a smaller doc, their class."""
    classes = marks.groupBy(*keys).agg(F.min("doc").alias("class"), F.count("*").alias("copies")).where("copies > 1")
    return join_counted(marks, classes, keys, "copies", total).where("doc != class").drop("copies")
