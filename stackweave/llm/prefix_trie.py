"""The trie of conversations' prefixes, by van Emde Boas recursion over depth.

Every conversation is rebuilt first: up to three opening turns of the conversation that its group of GROUP starts with,
then its own turns after as many. The turns of a rebuilt conversation are dealt into blocks of BLOCK. Sequences of
blocks are cut at half depth, and each distinct prefix up to a cut gets a name, made of the name where its half began
and of the hash of that half; the upper and all lower halves are then cut alike, in the same rounds, so that the rounds
grow with the logarithm of the longest conversation and each boundary of blocks is named once. Within a block nodes are
named from the block's beginning. A node of the trie is a distinct name.

Totals of subtrees go the same way upward: in each round the boundaries of every lower half add what they hold to the
cut above them, from the deepest cut halves to the smallest; then a node adds up its block. No step brings the turns of
a conversation, the members of a node or the children of a node together: aggregates are combined before they are
shuffled, joins are one to one or spread a hot key (ids.join_counted), turns are numbered by a sort over ranges, and
the ids that end in a node are hashed as a stream of packed pieces (a node's digest is one stream by its definition).

Defined results: null role or text counts as empty. Turns of one conversation with the same number go by role, then
by the text's hash; null numbers come first. Repeated rows are turns of their own. Rows with a null conv_id are left out. A
conversation without turns is a member of the root alone. A very long text counts by its hash and its words; names and
turns are told apart by 128 bits. An empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .ids import join_counted

GROUP = 20
#: Opening turns that a conversation may take over, at most.
OPENING = 3
#: Turns of a block, which is named without recursion.
BLOCK = 4
NAME = "struct<a:bigint,b:bigint>"


def root_name() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def named(*parts: Column) -> Column:
    """A name of 128 bits from all parts."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank: the place of each row among those of its conversation in this partition, from 1."""
    last, count = None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        if not len(conv):
            continue
        opens = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
        rank = np.arange(len(conv)) - np.repeat(opens, np.diff(np.append(opens, len(conv)))) + 1
        if last == conv[0]:
            rank[: opens[1] if len(opens) > 1 else len(conv)] += count
        last, count = conv[-1], int(rank[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*b.schema.names, "rank"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn): turns with their place from 1; turns with equal numbers go by role, then by the text's hash.

    A range of (conversation, turn) is one partition. A conversation that lies in several ranges adds the turns of those
    before; there is at most one such at each boundary, so that the table of these is as small as the number of ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    given = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("number"), role.alias("role"), named(role, text).alias("turn"), words.alias("words"))
    order = [F.col("conv"), F.col("number").asc_nulls_first(), F.col("role"), F.col("turn.a"), F.col("turn.b")]
    ranges = given.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.struct("turn.a", "turn.b", "words").alias("turn"), F.spark_partition_id().alias("part"))
    rows = scratch.written(ranges.mapInArrow(ranked, "conv long, turn struct<a:bigint,b:bigint,words:bigint>, part int, rank long"), "turns")
    several = rows.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.join(F.broadcast(several), "conv").groupBy("conv", "part").agg(F.count("*").alias("n"))  # one conversation a boundary of ranges
    shift = scratch.written(counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shift")
    return rows.join(F.broadcast(shift), ["conv", "part"], "left").select("conv", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, n turns), (turns: conv, n, pos, turn) of the rebuilt conversations."""
    own = rows.groupBy("conv").agg(F.count("*").alias("n_own"))
    start = F.col("conv") - F.col("conv") % GROUP
    heads = rows.where((F.col("conv") == start) & (F.col("pos") <= OPENING)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("head"))
    convs = own.select("conv", "n_own", start.alias("base"), (F.crc32(F.col("conv").cast("string")) % (OPENING + 1)).cast("int").alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = scratch.written(convs.select("conv", "n_own", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n")), "conversations")
    total = convs.agg(F.coalesce(F.sum("n_own"), F.lit(0))).first()[0]
    tails = join_counted(rows, convs.select("conv", "n_own", "h", "n", F.size("head").alias("k")), ["conv"], "n_own", total)
    tails = tails.where("pos > h").select("conv", "n", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn")
    opened = convs.select("conv", "n", F.inline("head"))
    return convs.select("conv", "n"), tails.unionByName(opened.select("conv", "n", F.col("pos").cast("long").alias("pos"), "turn"))


def boundaries(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(conv, m, name) of the prefix that ends with each conversation's m-th full block, and the largest m.

    Round k names the cuts at odd multiples of 2 ** k blocks: the name where the half began and the half's hash.
    """
    halves = [scratch.written(blocks.where(F.size("turns") == BLOCK).select("conv", F.col("j").alias("i"), named(F.col("turns")).alias("hash")), "halves")]
    most = (halves[0].agg(F.max("i")).first()[0] or 0) + 1
    side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("hash")))
    while 2 ** len(halves) <= most:
        pairs = halves[-1].groupBy("conv", F.shiftright("i", 1).alias("half")).agg(side(0).alias("left"), side(1).alias("right"))
        halves.append(scratch.written(pairs.where("left IS NOT NULL AND right IS NOT NULL").select("conv", F.col("half").alias("i"), named(F.col("left"), F.col("right")).alias("hash")), "halves"))
    parts: list[DataFrame] = []
    for k in reversed(range(len(halves))):
        half = halves[k].where(F.col("i") % 2 == 0)
        new = half.where("i = 0").select("conv", F.lit(1 << k).cast("long").alias("m"), named(root_name(), F.col("hash")).alias("name"))
        if parts:
            known = reduce(DataFrame.unionByName, parts).select("conv", F.shiftright("m", k).alias("i"), "m", "name")
            new = new.unionByName(half.join(known, ["conv", "i"]).select("conv", (F.col("m") + (1 << k)).alias("m"), named(F.col("name"), F.col("hash")).alias("name")))
        parts.append(scratch.written(new, "names"))
    return reduce(DataFrame.unionByName, parts), most


def under_boundaries(nodes: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(name, deeper_saved, deeper_leaves): what the nodes below each boundary of blocks hold.

    A boundary first holds its block. In round k those in the lower half of their band of 2 ** (k + 1) blocks add what they
    hold to the cut above, after which both halves go on by themselves.
    """
    sums = (F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    block = nodes.groupBy(F.col("start").alias("name")).agg(*sums)
    held = nodes.where(F.col("depth") % BLOCK == 0).select("name", "conv", (F.col("depth") / BLOCK).cast("long").alias("m")).join(block, "name", "left").na.fill(0, ["saved", "leaf"])
    for k in reversed(range((most - 1).bit_length())):
        held = scratch.written(held, "held")
        place = F.col("m") - 1
        lower = held.where(F.shiftright(place, k) % 2 == 1)
        by_path = lower.groupBy("conv", F.shiftleft(F.shiftright(place, k), k).alias("m")).agg(*sums)
        added = by_path.join(names, ["conv", "m"]).groupBy("name").agg(F.sum("saved").alias("more"), F.sum("leaf").alias("more_leaf"))
        held = held.join(added, "name", "left").select("name", "conv", "m", *((F.col(c) + F.coalesce(a, F.lit(0))).alias(c) for c, a in (("saved", "more"), ("leaf", "more_leaf"))))
    return held.select("name", F.col("saved").alias("deeper_saved"), F.col("leaf").alias("deeper_leaves"))


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, conv), sorted, as pieces (a, b, conv of the first, decimal ids joined by commas)."""
    for batch in batches:
        a, b, conv = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        opens = np.flatnonzero(new)
        text = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(opens.tolist(), [*opens[1:].tolist(), len(a)])]
        yield pa.RecordBatch.from_arrays([pa.array(x[opens]) for x in (a, b, conv)] + [pa.array(text, pa.string())], ["a", "b", "conv", "ids"])


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (a, b, ends_sha256); the state of one hash is all that is held."""
    now, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])


def digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of rows (name, conv): a sort over ranges, then pieces of ids in their order for each name."""
    flat = ends.select("name.a", "name.b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = flat.mapInArrow(packed, "a long, b long, conv long, ids string").repartition("a", "b").sortWithinPartitions("a", "b", "conv")
    return pieces.mapInArrow(hashed, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("name"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch.temporary(conversations.sparkSession) as keep:
        return keep(nodes_of(conversations), "trie")


def nodes_of(conversations: DataFrame) -> DataFrame:
    convs, turns = rebuilt(numbered(conversations))
    j = F.floor((F.col("pos") - 1) / BLOCK).alias("j")
    blocks = turns.groupBy("conv", "n", j).agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("turns"))
    blocks = scratch.written(blocks.select("conv", "n", "j", F.col("turns.turn").alias("turns")), "blocks")
    names, most = boundaries(blocks)
    begin = names.select("conv", F.col("m").alias("j"), F.col("name").alias("start"))
    end = names.select("conv", (F.col("m") - 1).alias("j"), F.col("name").alias("end"))
    known = blocks.join(begin, ["conv", "j"], "left").join(end, ["conv", "j"], "left").withColumn("start", F.coalesce("start", root_name()))
    path = F.transform("turns", lambda _, i: F.when(i == BLOCK - 1, F.col("end")).otherwise(named(F.col("start"), F.slice("turns", F.lit(1), i + 1))))
    steps = known.select("conv", "n", "j", "start", "turns", path.alias("path")).select("*", F.posexplode("path").alias("t", "name"))
    visits = steps.select(
        "conv",
        "name",
        "start",
        F.when(F.col("t") == 0, F.col("start")).otherwise(F.col("path")[F.col("t") - 1]).alias("parent"),
        F.slice("path", F.lit(1), F.col("t") + 1).alias("up"),
        (F.col("j") * BLOCK + F.col("t") + 1).alias("depth"),
        F.col("turns")[F.col("t")]["words"].alias("words"),
        (F.col("j") * BLOCK + F.col("t") + 1 == F.col("n")).alias("last"),
    )
    # all that a name determines is in the key, so that the aggregate combines plain numbers before its shuffle
    nodes = visits.groupBy("name", "start", "parent", "up", "depth", "words").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    nodes = scratch.written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")), "nodes")
    digest = digests(visits.where("last").select("name", "conv").unionByName(convs.where("n = 0").select(root_name().alias("name"), "conv")))

    held = nodes.join(under_boundaries(nodes, names, most), "name", "left").na.fill(0, ["deeper_saved", "deeper_leaves"])
    none = F.lit(0).cast("long")
    up = held.select(F.explode("up").alias("name"), (F.col("saved") + F.col("deeper_saved")).alias("saved_tokens"), (F.col("leaf") + F.col("deeper_leaves")).alias("n_leaves"), none.alias("n_children"))
    child = nodes.where("depth > 1").select(F.col("parent").alias("name"), none.alias("saved_tokens"), none.alias("n_leaves"), F.lit(1).cast("long").alias("n_children"))
    totals = up.unionByName(child).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves", "n_children")))
    found = nodes.select("name", "parent", "depth", "conv", "n_convs").join(totals, "name")

    whole = nodes.agg(F.coalesce(F.sum("saved"), none).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.count("*").alias("n_nodes"))
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(whole)  # one row each
    top = top.select(root_name().alias("name"), F.lit(None).cast(NAME).alias("parent"), none.alias("depth"), "conv", "n_convs", "saved_tokens", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "n_children")
    found = scratch.written(found.unionByName(top).join(digest, "name", "left"), "found")
    parents = found.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("of"))
    below = join_counted(found.where("depth > 0"), parents, ["parent"], "of", found.count())
    root = found.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "of": none})
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return below.unionByName(root).select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
