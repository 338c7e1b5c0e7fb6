"""Editing of a stack's network of pairs: limits, dates, pairs, positions, a reference network, coherence, area ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import spanning_tree


def positions(pairs: DataFrame) -> DataFrame:
    """pairs with index: their place, from 0, in the stack's list sorted by dates, then ids."""
    order = Window.partitionBy("stack").orderBy("t_ref", "t_sec", "ref", "sec")
    return pairs.withColumn("index", F.row_number().over(order).cast("long") - 1)


def either_way(listed: DataFrame) -> DataFrame:
    """(stack, ref, sec) of listed pairs in both orientations."""
    one = listed.select("stack", F.col("ref").cast("long").alias("ref"), F.col("sec").cast("long").alias("sec"))
    return one.unionByName(one.select("stack", F.col("sec").alias("ref"), F.col("ref").alias("sec"))).distinct()


def area_ratio(pixels: DataFrame, threshold: float) -> DataFrame:
    """(stack, ref, sec, ratio): the share of a pair's valid pixels (coh) that reach the threshold."""
    good = F.avg((F.col("coh") >= threshold).cast("double"))
    return pixels.where("coh IS NOT NULL AND NOT isnan(coh)").groupBy("stack", "ref", "sec").agg(good.alias("ratio"))


def tree_of(pairs: DataFrame, weight: str) -> DataFrame:
    """(stack, ref, sec): each stack's spanning forest of largest total weight; a group is one stack's pairs."""
    kind = dict(pairs.dtypes)
    run = lambda p: spanning_tree(p, weight)[["stack", "ref", "sec"]]
    slim = pairs.select("stack", "ref", "sec", weight)
    return slim.groupBy("stack").applyInPandas(run, f"stack {kind['stack']}, ref {kind['ref']}, sec {kind['sec']}")


def edited(
    pairs: DataFrame,
    *,
    temp_max: float | None = None,
    perp_max: float | None = None,
    conn_max: int | None = None,
    start: int | None = None,
    end: int | None = None,
    exclude_dates: Sequence[int] = (),
    exclude_pairs: DataFrame | None = None,
    exclude_index: DataFrame | None = None,
    reference: DataFrame | None = None,
    min_coherence: float | None = None,
    min_ratio: float | None = None,
    keep_tree: bool = False,
) -> DataFrame:
    """The pairs (stack, ref, sec, t_ref, t_sec, dt_days, bperp, and coh, ratio where asked for) that all options leave.

    start, end and exclude_dates are days (t) of either scene. conn_max: dates of the stack's pairs that a pair may reach
    ahead. exclude_pairs, reference: (stack, ref, sec) in either orientation; exclude_index: (stack, index), positions in
    the list as given. min_coherence and min_ratio drop pairs under them or without a value; with keep_tree not those of
    the spanning tree of largest coherence over the pairs that the other options leave.
    """
    p = pairs
    if exclude_index is not None:
        p = positions(p).join(exclude_index.select("stack", F.col("index").cast("long").alias("index")), ["stack", "index"], "left_anti").drop("index")
    if conn_max is not None:
        ends = pairs.select("stack", F.col("t_ref").alias("t")).union(pairs.select("stack", "t_sec")).distinct()
        number = ends.withColumn("n", F.row_number().over(Window.partitionBy("stack").orderBy("t")))
        side = lambda c: number.select("stack", F.col("t").alias(f"t_{c}"), F.col("n").alias(f"_{c}"))
        p = p.join(side("ref"), ["stack", "t_ref"]).join(side("sec"), ["stack", "t_sec"]).where(F.abs(F.col("_sec") - F.col("_ref")) <= conn_max).drop("_ref", "_sec")
    limits: list[Column] = []
    if temp_max is not None:
        limits.append(F.abs("dt_days") <= temp_max)
    if perp_max is not None:
        limits.append(F.abs("bperp") <= perp_max)
    if start is not None:
        limits.append(F.least("t_ref", "t_sec") >= start)
    if end is not None:
        limits.append(F.greatest("t_ref", "t_sec") <= end)
    if len(exclude_dates):
        limits.append(~F.col("t_ref").isin(*exclude_dates) & ~F.col("t_sec").isin(*exclude_dates))
    for one in limits:
        p = p.where(one)
    if exclude_pairs is not None:
        p = p.join(either_way(exclude_pairs), ["stack", "ref", "sec"], "left_anti")
    if reference is not None:
        p = p.join(either_way(reference), ["stack", "ref", "sec"], "left_semi")
    weak = F.lit(False)
    if min_coherence is not None:
        weak = weak | F.coalesce(F.col("coh") < min_coherence, F.lit(True))
    if min_ratio is not None:
        weak = weak | F.coalesce(F.col("ratio") < min_ratio, F.lit(True))
    if min_coherence is None and min_ratio is None:
        return p
    if not keep_tree:
        return p.where(~weak)
    tree = tree_of(p.where("coh IS NOT NULL"), "coh").withColumn("_tree", F.lit(True))
    return p.join(tree, ["stack", "ref", "sec"], "left").where(~weak | F.coalesce("_tree", F.lit(False))).drop("_tree")
