"""Secrets in texts, told from copied examples by corpus-wide ownership, in DataFrame operations only.

Candidates are found by patterns, with their places in code points. The hash of each candidate's secret part is
then counted over the corpus: in how many distinct repositories (texts of an owner) and by how many distinct owners
(sources) it occurs. A value that several owners hold is an example that people copy; one that a single owner holds,
in letters mixed enough, looks live.

The texts are scanned once, into a table of spans. What follows works on distinct texts: ownership comes from counts
that are combined before each shuffle, and values or texts that very many rows share are joined by a broadcast of a
bounded number of them.

Defined results: null and empty texts have no spans. Each row has the spans of its own text, also where rows repeat a
doc_id or have none. Rows with a null source are an owner of their own. Equal texts of one source are one repository.
A value that occurs twice in a text has two spans. Spans that start together are in the order of KINDS. Very long
texts are scanned whole. An empty table gives no rows. Columns but doc_id, source and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .ids import join_counted

#: kind: (pattern whose matches are leftmost and non-overlapping, group of the secret, its least length, quick test)
KINDS = {
    "assign": (
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    ),
    # a run of these characters that is too short can't hold or hide a longer one, so the length is in the pattern
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
}
#: Owners from which on a value counts as a copied example.
COPIED = 2
#: Distinct characters that a value needs to look live.
MIXED = 6


#: Matches of a block: places are summed up within blocks, and over blocks.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> in code points, ends exclusive; empty where the quick test finds none.

    The pieces between matches come from split() with the same pattern, so that a match starts after all pieces
    and matches before it. These lengths are summed up in blocks, so that the work grows with the matches.
    """
    pattern, group, least, test = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), value.alias("v"))  # one piece more than matches
    sized = F.transform(both, lambda x: F.struct(F.char_length(x["p"]).alias("gap"), F.coalesce(F.char_length(x["m"]), F.lit(0)).alias("width"), x["v"].alias("value")))
    block = lambda all, k: F.slice(all, k * BLOCK + 1, F.lit(BLOCK))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x["gap"] + x["width"])

    def placed(part: Column, at: Column) -> Column:
        one = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["width"]).alias("end"), x["value"].alias("value"))
        start = F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["width"]).alias("at"), F.concat(acc["out"], F.array(one(acc, x))).alias("out")), lambda acc: acc["out"])

    def spans(all: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all) - 1) / BLOCK).cast("int"))
        before = lambda sums: F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        starts = before(F.transform(numbers, lambda k: total(block(all, k))))
        return F.flatten(F.transform(starts, lambda at, k: placed(block(all, k), at)))

    found = F.filter(let(sized, spans), lambda x: F.char_length(x["value"]) >= least)
    return F.when(text.rlike(test), found).otherwise(F.array().cast(SPANS))


TEXT = ["t0", "t1"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, t0, t1, spans) per row: two hashes of the text, and its spans of all kinds."""
    text = F.coalesce("text", F.lit(""))

    def spans_of(rank: int, kind: str) -> Column:
        mixed = lambda m: F.size(F.array_distinct(F.split(m["value"], ""))) >= MIXED
        return F.transform(matches(text, kind), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("secret_hash"), mixed(m).alias("mixed")))

    spans = F.concat(*(spans_of(rank, kind) for rank, kind in enumerate(KINDS)))
    return docs.select("doc_id", "source", F.xxhash64(text).alias("t0"), F.xxhash64(F.lit("\x00"), text).alias("t1"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Per secret_hash the distinct repositories and owners, and n, its spans. Distinct first, so that a hot value is spread."""
    each = found.select("source", *TEXT, F.explode("spans.secret_hash").alias("secret_hash"))
    # one row per value, owner and text; then per value and owner; then per value
    per_text = each.groupBy("secret_hash", F.coalesce("source", F.lit("")).alias("owner"), *TEXT).agg(F.count("*").alias("n"))
    per_owner = per_text.groupBy("secret_hash", "owner").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    return per_owner.groupBy("secret_hash").agg(F.sum("texts").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n"))


def judged(found: DataFrame, total: int) -> DataFrame:
    """(t0, t1, n_rows, judged) per distinct text: its spans, in order, with their owners and verdict."""
    texts = found.groupBy(*TEXT).agg(F.first("spans").alias("spans"), F.count("*").alias("n_rows"))
    each = texts.select(*TEXT, "n_rows", F.inline("spans"))
    known = join_counted(each, ownership(found), ["secret_hash"], "n", total)
    verdict = F.when(F.col("n_owners") >= COPIED, "example").when(F.col("mixed"), "live").otherwise("weak")
    span = F.struct("start", "rank", "kind", "end", "secret_hash", "n_repositories", "n_owners", verdict.alias("verdict"))
    return known.groupBy(*TEXT).agg(F.first("n_rows").alias("n_rows"), F.array_sort(F.collect_list(span)).alias("judged"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row; a span has start, rank, kind, end, secret_hash, n_repositories, n_owners and verdict.

    example: COPIED owners or more hold the value. live: one owner, characters mixed enough. weak: the rest.
    """
    with scratch.temporary(docs.sparkSession) as keep:
        rows = scratch.written(candidates(docs.select("doc_id", "source", "text")), "spans")
        found = rows.where(F.size("spans") > 0)
        n, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
        done = join_counted(found.select("doc_id", *TEXT), judged(found, spans), TEXT, "n_rows", n, F.size("judged")).select("doc_id", F.col("judged").alias("spans"))
        none = F.array().cast(done.schema["spans"].dataType)
        return keep(done.unionByName(rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans"))), "secrets")


def summary(docs: DataFrame) -> DataFrame:
    """Per row of docs the counts, and the spans as text; those of verdict live are named a second time."""
    count = lambda c, v: F.size(F.filter("spans", lambda x: x[c] == v)).cast("long")
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    live = lambda x: F.when(x["verdict"] == "live", F.concat_ws(":", F.lit("live"), x["start"], x["end"]))
    return scan(docs).select(
        "doc_id",
        *(count("kind", k).alias(f"n_{k}") for k in KINDS),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
        F.array_join(F.transform("spans", named), ",").alias("base"),
        F.array_join(F.flatten(F.transform("spans", lambda x: F.array_compact(F.array(named(x), live(x))))), ",").alias("spans"),
    )
