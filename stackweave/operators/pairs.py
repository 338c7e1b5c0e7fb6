"""Acquisition pairs: self-joins of a stack's scenes, predicates, sequential networks, set operations on pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G

#: Fixed default values of pair selection.
TARGETS = (6, 12, 24, 36, 48, 72, 96)
TOLERANCE = 3
DT_MAX = 120
PB_MAX = 150.0
MIN_DEGREE, MAX_DEGREE = 3, 5
#: A missing baseline counts as this many metres.
NO_BASELINE = 10_000.0


def all_pairs(scenes: DataFrame, dt_max: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(stack, ref, sec, t_ref, t_sec, dt_days, bperp): pairs of a stack's scenes, earlier first.

    Columns to ``carry`` come along from both ends, as <name>_ref and <name>_sec.

    With ``dt_max`` scenes meet in buckets of that many days, each later scene in its own and the one before, so
    that a stack's work grows with its scenes and not with their square. Without it all pairs of a stack are formed.
    """
    cols = ["stack", "scene", "t", "bperp_m", *carry]
    a = scenes.select("stack", *(F.col(c).alias(f"a_{c}") for c in cols[1:]))
    b = scenes.select("stack", *(F.col(c).alias(f"b_{c}") for c in cols[1:]))
    keys, near = ["stack"], F.col("a_t") < F.col("b_t")
    if dt_max is not None:
        own = lambda c: F.floor(F.col(c) / dt_max)
        a = a.withColumn("bucket", own("a_t"))
        b = b.withColumn("bucket", F.explode(F.array(own("b_t"), own("b_t") - 1)))
        keys, near = [*keys, "bucket"], near & (F.col("b_t") - F.col("a_t") <= dt_max)
    return a.join(b, keys).where(near).select(
        "stack",
        F.col("a_scene").alias("ref"),
        F.col("b_scene").alias("sec"),
        F.col("a_t").alias("t_ref"),
        F.col("b_t").alias("t_sec"),
        (F.col("b_t") - F.col("a_t")).alias("dt_days"),
        F.round(F.abs(F.col("b_bperp_m") - F.col("a_bperp_m")), 5).alias("bperp"),
        *(F.col(f"{end}_{c}").alias(f"{c}_{name}") for c in carry for end, name in (("a", "ref"), ("b", "sec"))),
    )


def later_scenes(scenes: DataFrame) -> DataFrame:
    """(stack, scene, n_later, dt_max, bperp_max): what a scene's pairs with all later ones of its stack amount to.

    The numbers of all combinations without forming them: a stack is sorted once, from its last day on.
    """
    w = Window.partitionBy("stack").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    most, least = F.max("bperp_m").over(w), F.min("bperp_m").over(w)
    far = F.round(F.greatest(F.abs(most - F.col("bperp_m")), F.abs(least - F.col("bperp_m"))), 5)
    out = scenes.select("stack", "scene", F.count("*").over(w).alias("n_later"), (F.max("t").over(w) - F.col("t")).alias("dt_max"), far.alias("bperp_max"))
    return out.where("n_later > 0")


def pairs_of(asked: DataFrame, scenes: DataFrame) -> DataFrame:
    """(stack, ref, sec, t_ref, t_sec, dt_days, bperp): every combination of the asked scenes (stack, scene) with all scenes
    of their stack, earlier first (same day: the smaller id), each once; scenes without a day are dropped.

    The list grows with the scenes asked for times a stack's scenes; all combinations come from asking for all.
    """
    dated = scenes.where("t IS NOT NULL").select("stack", "scene", "t", "bperp_m")
    want = dated.join(asked.select("stack", "scene").distinct(), ["stack", "scene"], "left_semi")
    other = dated.select("stack", *(F.col(c).alias(f"b_{c}") for c in ("scene", "t", "bperp_m")))
    both = want.join(other, "stack").where("scene != b_scene")
    ends = F.array_sort(F.array(F.struct("t", "scene", "bperp_m"), F.struct(F.col("b_t").alias("t"), F.col("b_scene").alias("scene"), F.col("b_bperp_m").alias("bperp_m"))))
    sorted_ends = both.select("stack", ends.alias("e")).select("stack", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    turned = sorted_ends.select(
        "stack", F.col("a.scene").alias("ref"), F.col("b.scene").alias("sec"), F.col("a.t").alias("t_ref"), F.col("b.t").alias("t_sec"),
        (F.col("b.t") - F.col("a.t")).alias("dt_days"), F.round(F.abs(F.col("b.bperp_m") - F.col("a.bperp_m")), 5).alias("bperp"),
    )
    return turned.distinct()


def usable(targets: Sequence[int] = TARGETS, tol: int = TOLERANCE, dt_max: int = DT_MAX, pb_max: float = PB_MAX) -> Column:
    """Near a target interval, within the longest interval and baseline; a missing baseline is too long."""
    # plain comparisons, the cheap ones first: they are compiled into the join
    near = reduce(or_, (F.abs(F.col("dt_days") - t) <= tol for t in targets))
    return (F.col("dt_days") <= dt_max) & near & (F.coalesce("bperp", F.lit(NO_BASELINE)) <= pb_max)


def primary_pairs(scenes: DataFrame, **limits) -> DataFrame:
    dt_max = limits.get("dt_max", DT_MAX)
    return all_pairs(scenes, dt_max).where(usable(**limits))


def ends(pairs: DataFrame) -> DataFrame:
    """(stack, scene, other) for both ends of each pair."""
    return pairs.select("stack", F.inline(F.array(F.struct(F.col("ref").alias("scene"), F.col("sec").alias("other")), F.struct(F.col("sec").alias("scene"), F.col("ref").alias("other")))))


def degrees(pairs: DataFrame, scenes: DataFrame, low: int = 2) -> DataFrame:
    """Links of each scene, and whether they are fewer than ``low``."""
    n = ends(pairs).groupBy("stack", "scene").agg(F.count("*").alias("degree"))
    out = scenes.select("stack", "scene").join(n, ["stack", "scene"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.withColumn("is_low", F.col("degree") < low)


def sequential(scenes: DataFrame, n: int, max_days: int | None = None) -> DataFrame:
    """Each date with the next ``n`` of its stack, within ``max_days``."""
    w = Window.partitionBy("stack").orderBy("t", "scene")
    ahead = F.array(*(F.struct(F.lead("scene", i).over(w).alias("sec"), F.lead("t", i).over(w).alias("t_sec")) for i in range(1, n + 1)))
    out = scenes.select("stack", F.col("scene").alias("ref"), "t", ahead.alias("ahead"))
    out = out.select("stack", "ref", "t", F.explode("ahead").alias("x")).where("x.sec IS NOT NULL")
    out = out.select("stack", "ref", F.col("x.sec").alias("sec"), (F.col("x.t_sec") - F.col("t")).alias("dt_days"))
    return out.where(F.col("dt_days") <= max_days) if max_days is not None else out


def star(scenes: DataFrame) -> DataFrame:
    """Each stack's first date with all later ones."""
    first = scenes.groupBy("stack").agg(F.min_by(F.struct("scene", "t"), F.struct("t", "scene")).alias("f"))
    return scenes.join(first, "stack").where("t > f.t").select("stack", F.col("f.scene").alias("ref"), F.col("scene").alias("sec"), (F.col("t") - F.col("f.t")).alias("dt_days"))


def topology(scenes: DataFrame, *, reference: bool = False, explicit: DataFrame | None = None, max_days: int | None = None, bandwidth: int = 3) -> DataFrame:
    """The first that is given: star of the reference date, explicit pairs, all within max_days, next ``bandwidth``."""
    cols = ["stack", "ref", "sec", "dt_days"]
    if reference:
        return star(scenes).select(*cols)
    if explicit is not None:
        return explicit.select(*cols)
    if max_days is not None:
        return all_pairs(scenes, max_days).select(*cols)
    return sequential(scenes, bandwidth).select(*cols)


def canonical(pairs: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs of known scenes, earlier first and without self-pairs; pairs with an unknown scene)."""
    day = scenes.select("scene", "t")
    known = pairs.join(day.withColumnsRenamed({"scene": "ref", "t": "t_ref"}), "ref").join(day.withColumnsRenamed({"scene": "sec", "t": "t_sec"}), "sec")
    swap = (F.col("t_sec") < F.col("t_ref")) | ((F.col("t_sec") == F.col("t_ref")) & (F.col("sec") < F.col("ref")))
    kept = known.where("ref != sec").select(F.when(swap, F.col("sec")).otherwise(F.col("ref")).alias("ref"), F.when(swap, F.col("ref")).otherwise(F.col("sec")).alias("sec")).distinct()
    ids = scenes.select("scene")
    lost = pairs.join(ids.withColumnRenamed("scene", "ref"), "ref", "left_anti").unionByName(pairs.join(ids.withColumnRenamed("scene", "sec"), "sec", "left_anti")).distinct()
    return kept, lost


def layered(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key, from the last source that has it; ``source`` is its number."""
    n = len(sources) - 1
    return by_priority(sources[::-1], keys).withColumn("source", n - F.col("source"))


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key, from the first source that has it; ``source`` is its number."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    columns = rows.columns
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "source").alias("_r")).select("_r.*")


def quality_class(score: Column, hundred: bool = False) -> Column:
    """good from .40, risky from .25, bad below; null: unknown."""
    x = score / 100 if hundred else score
    return F.when(score.isNull(), "unknown").when(x >= 0.40, "good").when(x >= 0.25, "risky").otherwise("bad")


#: Baselines beyond this many metres are implausible.
IMPLAUSIBLE = 5000.0
#: Seconds of a revolution; node times off by more than NODE_TOLERANCE are off by whole revolutions.
REVOLUTION, NODE_TOLERANCE = 5929, 600


def route(bperp: Column) -> Column:
    """missing, fallback for an implausible baseline, else ok."""
    return F.when(bperp.isNull(), "missing").when(F.abs(bperp) > IMPLAUSIBLE, "fallback").otherwise("ok")


def repaired_node_time(time: Column, expected: Column) -> Column:
    """A node time moved by whole revolutions towards the expected one."""
    off = time - expected
    return F.when(F.abs(off) > NODE_TOLERANCE, time - F.bround(off / REVOLUTION, 0) * REVOLUTION).otherwise(time)


def half_baseline_positions(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """(stack, scene, position): means of half baselines, minus at the earlier end, zeroed at the stack's first scene."""
    half = pairs.select("stack", F.inline(F.array(F.struct(F.col("ref").alias("scene"), (-F.col("bperp") / 2).alias("p")), F.struct(F.col("sec").alias("scene"), (F.col("bperp") / 2).alias("p")))))
    mean = half.groupBy("stack", "scene").agg(F.avg("p").alias("p"))
    first = mean.join(scenes.select("scene", "t"), "scene").groupBy("stack").agg(F.min_by("p", F.struct("t", "scene")).alias("zero"))
    return mean.join(first, "stack").select("stack", "scene", (F.col("p") - F.col("zero")).alias("position"))


def anchor_baselines(vectors: DataFrame) -> DataFrame:
    """(stack, scene, bperp) against each stack's first scene: the part of the distance of the orbits across the beam.

    vectors: (stack, scene, t, lat, lon, r and v struct<x, y, z>), positions and speeds at a scene's own time. The
    beam's upward direction is that of the first scene. Scenes without a position, or with an implausible baseline,
    get null, as do all of a stack whose first has none.
    """
    first = vectors.groupBy("stack").agg(F.min_by(F.struct("scene", "lat", "lon", "r", "v"), F.struct("t", "scene")).alias("a"))
    ground = G.ecef(F.col("a.lat"), F.col("a.lon"), F.lit(0.0))
    first = first.withColumn("beam", G.of_length_one(G.difference(F.col("a.r"), ground))).withColumn("up", G.of_length_one(G.cross(F.col("a.v"), F.col("beam"))))
    own = G.dot(F.col("up"), G.difference(F.col("r"), F.col("a.r")))
    b = F.when(F.col("a.r").isNull(), F.lit(None).cast("double")).when(F.col("scene") == F.col("a.scene"), 0.0).when(F.abs(own) <= IMPLAUSIBLE, own)
    return vectors.join(first.select("stack", "a", "up"), "stack").select("stack", "scene", b.alias("bperp"))
