"""The corpus pipeline: five stages of the llm package's operators, each over all that the stage before kept.

Every function takes (spark, docs, sf_dir); all but the last return the columns of documents. Null texts count as
empty throughout; very long ones are taken whole. An empty table stays empty in each stage. Further columns pass
through all stages but the last, whatever their names. Rows with a null doc_id are never near copies nor contaminated:
they pass, but for toxic ones, those that line dedup leaves no word of, and the last stage encodes them. Rows that
repeat a doc_id are scored each by its text, share their lines, count once in the near-copy join (with the text that
sorts first) and go or stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackweave.llm import decontamination, jaccard, lines, scratch, sentencepiece_viterbi, toxicity
from stackweave.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. The model is fitted on labelled documents of this stage's input.

    Without labels of both classes nothing is learned and all stay.
    """
    return toxicity.filter_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id has go; so do documents of which no word is left by that.

    Ties are none: of all that hold a line the one with the smallest doc_id keeps it. A column n_chars follows the text.
    """
    out = lines.keep_unique_lines(docs)
    return out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by 5-word shingles with a similarity of 0.8 or more, that with the smallest id stays.

    Links chain: a document goes if it reaches one with a smaller id over others. Texts without words link with none.
    """
    return jaccard.keep_one(docs, jaccard.Rule(5, 80, 100))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go: 13 words, or a shorter item, with a fifth of them replaced at most."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    model = tokenizer_file("piece_bpe_32k.model")
    rows = sentencepiece_viterbi.round_trip(docs.select("doc_id", "text", "lang", "source"), model)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: The learned scores and the Viterbi encoding have no SQL form; tests hold each stage against what its operator's own
#: brute force keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again by the next.

    The last stage's rows are written, too; the tables before it are deleted.
    """
    with scratch.temporary(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
