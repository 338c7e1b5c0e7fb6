"""What the classifiers share: held-out rows, bounded samples of labelled rows, scores of a segment's rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts of more bytes are scored whole, but not learned from.
LONGEST = 256 << 10


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5: labels of these rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows (text, label) of at most LONGEST bytes for learning, none held out.

    The rows with the smallest hash of the id are taken, so that the choice is the same in every run. Rows of
    labels with a null id or label are left out; an id with several labels counts once, with its largest, and one
    with several texts with that which sorts first. So what learning brings to the driver is bounded.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    found = short.join(F.broadcast(ids), "doc_id")  # bound rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def segment_sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x[at[i]:at[i + 1]], 0 for empty segments; x may have columns."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
