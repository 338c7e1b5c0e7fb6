"""Graphs of pairs: components by shrinking links; the order-dependent repair and spanning trees per part of a stack."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, temporary
from .pairs import DT_MAX, MAX_DEGREE, MIN_DEGREE, PB_MAX, all_pairs, usable

#: Days of a window in which links are thinned: a multiple of the longest interval, so that few links leave it.
THIN_DAYS = 4 * DT_MAX


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each reaches by the links a[i], b[i]."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]


def preferred_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links make up the spanning forest that prefers earlier links: each part takes its first way out, again and again."""
    label, left, kept = np.arange(n), np.arange(len(a)), np.zeros(len(a), bool)
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        if not apart.any():
            return kept
        left, x, y = left[apart], x[apart], y[apart]
        first = np.full(n, len(a))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        take = np.unique(first[first < len(a)])
        kept[take] = True
        label = least_labels(n, label[a[take]], label[b[take]])[label]


def star_components(links: DataFrame, by: Sequence[str] = (), write: Callable[[DataFrame], DataFrame] = cut, rounds: int = 60) -> DataFrame:
    """(by, id, component) of links (by, u, v): the smallest id that each reaches, by large-star and small-star steps.

    Each step joins the links with the least neighbour of each id, an aggregate that is combined before its shuffle.
    The steps grow with the logarithm of the ids; links that have not settled after ``rounds`` are an error.
    """
    by = list(by)
    now = write(links.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*by, "u"]).where("v != m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        now = write(small.unionAll(least.select(*by, "u", F.col("m").alias("v"))).distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            roots = now.select(*by, F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(*by, F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
        mark = seen
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def thinned(t: pa.Table) -> pa.Table:
    """(stack, scene, root): the smallest scene that each scene of the links reaches by them."""
    ids, at = np.unique(np.concatenate([t["ref"].to_numpy(), t["sec"].to_numpy()]), return_inverse=True)
    root = least_labels(len(ids), at[: len(t)], at[len(t) :])
    return pa.table({"stack": t["stack"].slice(0, 1).take(pa.array(np.zeros(len(ids), np.int64))), "scene": pa.array(ids), "root": pa.array(ids[root])})


def components(pairs: DataFrame, scenes: DataFrame, days: int = THIN_DAYS) -> DataFrame:
    """(stack, scene, component): the smallest scene that each scene reaches by pairs (stack, ref, sec) of its stack.

    The links of a window of days are thinned where they are formed, to one root a scene; only roots that share a
    scene are linked further. So what goes through the rounds is a few links a window, however dense the pairs are.
    The day of a pair is its column t_ref or, where pairs have none, the scene's t (no window for unknown scenes).
    """
    with temporary(pairs.sparkSession) as keep:
        return keep(labelled(pairs, scenes, days), "components")


def labelled(pairs: DataFrame, scenes: DataFrame, days: int) -> DataFrame:
    kind = dict(pairs.dtypes)
    if "t_ref" not in pairs.columns:
        pairs = pairs.join(scenes.select("stack", F.col("scene").alias("ref"), F.col("t").alias("t_ref")), ["stack", "ref"], "left")
    links = pairs.select("stack", F.floor(F.col("t_ref") / days).alias("w"), F.col("ref").cast("long").alias("ref"), F.col("sec").cast("long").alias("sec"))
    local = cut(links.groupBy("stack", "w").applyInArrow(thinned, f"stack {kind['stack']}, scene long, root long"))
    own = local.groupBy("stack", "scene").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))  # a scene is in few windows
    across = own.where(F.size("roots") > 1).select("stack", F.col("root").alias("u"), F.explode("roots").alias("v"))
    label = star_components(across, ["stack"]).withColumnRenamed("id", "root")
    found = own.select("stack", "scene", "root").join(label, ["stack", "root"], "left").select("stack", "scene", F.coalesce("component", "root").alias("component"))
    return scenes.select("stack", "scene").join(found, ["stack", "scene"], "left").select("stack", "scene", F.coalesce("component", "scene").alias("component"))


def largest_component(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """The pairs within each stack's largest component (ties: the smallest label)."""
    label = components(pairs, scenes)
    size = label.groupBy("stack", "component").agg(F.count("*").alias("n"))
    best = size.groupBy("stack").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    kept = label.join(best, ["stack", "component"]).select("stack", F.col("scene").alias("ref"))
    return pairs.join(kept, ["stack", "ref"], "left_semi")


def repair_part(t: pa.Table, low: int, high: int, boost: bool) -> pa.Table:
    """Boost, then trim the network of one part of a stack; rows are its candidate pairs, ``primary`` those chosen so far.

    Scenes take turns in order of (time, id). A scene with fewer than ``low`` links gets its nearest candidates in
    time (ties: the earlier) until it has. Then, in turn, a scene with more than ``high`` loses its worst link (longest
    interval, then longest baseline, then largest id) whose other end has more than ``low``, or else at least ``low``.
    """
    ref, sec, dt, bp, chosen = (t[c].to_numpy(zero_copy_only=False) for c in ("ref", "sec", "dt_days", "bperp", "primary"))
    ids, first, at = np.unique(np.concatenate([ref, sec]), return_index=True, return_inverse=True)
    when = np.concatenate([t["t_ref"].to_numpy(), t["t_sec"].to_numpy()])[first]
    # scenes by turn
    turn = np.empty(len(ids), np.int64)
    turn[np.lexsort((ids, when))] = np.arange(len(ids))
    by_turn = ids[np.argsort(turn)]
    end = turn[at].reshape(2, -1)
    chosen = chosen.copy()
    degree = np.bincount(end[:, chosen].ravel(), minlength=len(ids))
    node, other, link = end.ravel(), end[::-1].ravel(), np.tile(np.arange(len(ref)), 2)
    nearest = np.lexsort((other, dt[link], node))
    begin = np.searchsorted(node[nearest], np.arange(len(ids) + 1))
    if boost:
        for s in np.flatnonzero(degree < low).tolist():
            for k in nearest[begin[s] : begin[s + 1]].tolist():
                if degree[s] >= low:
                    break
                if not chosen[link[k]]:
                    chosen[link[k]] = True
                    degree[s] += 1
                    degree[other[k]] += 1
    for s in np.flatnonzero(degree > high).tolist():
        own = nearest[begin[s] : begin[s + 1]]
        own = own[chosen[link[own]]]
        worst = own[np.lexsort((-by_turn[other[own]], -bp[link[own]], -dt[link[own]]))].tolist()
        while degree[s] > high:
            gone = next((k for least in (low + 1, low) for k in worst if degree[other[k]] >= least), None)
            if gone is None:
                break
            worst.remove(gone)
            chosen[link[gone]] = False
            degree[s] -= 1
            degree[other[gone]] -= 1
    return t.filter(pa.array(chosen))


def parts_at_gaps(scenes: DataFrame, gap: int) -> DataFrame:
    """scenes with stack a struct (stack, part): a part ends where the next scene is more than ``gap`` days later."""
    w = Window.partitionBy("stack").orderBy("t", "scene")
    new = (F.col("t") - F.lag("t").over(w) > gap).cast("int")
    part = F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(w)
    return scenes.withColumn("_new", new).withColumn("stack", F.struct("stack", part.alias("part"))).drop("_new")


def select_pairs(scenes: DataFrame, *, pb_max: float = PB_MAX, dt_max: int = DT_MAX, min_degree: int = MIN_DEGREE, max_degree: int = MAX_DEGREE, force_connect: bool = True, bad: DataFrame | None = None) -> DataFrame:
    """The network of each stack: usable pairs, repaired so that degrees fit. Bad scenes are left out first.

    The repair takes turns along a stack. No candidate crosses a gap of more than dt_max days, so that the parts
    between gaps are independent groups; a group holds its candidate pairs, a bounded number a scene.
    """
    if bad is not None:
        scenes = scenes.join(bad.select("scene"), "scene", "left_anti")
    near = all_pairs(parts_at_gaps(scenes, dt_max), dt_max).where(F.col("bperp") <= pb_max).withColumn("primary", usable(dt_max=dt_max, pb_max=pb_max))
    near = near.select("stack.*", *(c for c in near.columns if c != "stack"))
    return near.groupBy("stack", "part").applyInArrow(lambda t: repair_part(t, min_degree, max_degree, force_connect), near.schema).drop("part")


def burst_pairs(scenes: DataFrame, **limits) -> DataFrame:
    """(stack, ref, sec, ...) of bursts whose node is the date: select_pairs() of the dates of each stack, given to all bursts.

    scenes: (stack, burst, scene, t, bperp_m). A date's baseline is the mean of its bursts; each pair of dates gives a
    pair of scenes for every burst position that has both dates.
    """
    dates = scenes.groupBy("stack", "t").agg(F.avg("bperp_m").alias("bperp_m")).withColumn("scene", F.col("t"))
    chosen = select_pairs(dates, **limits).select("stack", F.col("ref").alias("t_ref"), F.col("sec").alias("t_sec"), "dt_days", "bperp")
    side = lambda t, name: scenes.select("stack", "burst", F.col("t").alias(t), F.col("scene").alias(name))
    return chosen.join(side("t_ref", "ref"), ["stack", "t_ref"]).join(side("t_sec", "sec"), ["stack", "burst", "t_sec"]).select("stack", "burst", "ref", "sec", "t_ref", "t_sec", "dt_days", "bperp")


def spanning_tree(p: pd.DataFrame, weight: str) -> pd.DataFrame:
    """Edges of a stack's spanning forest of largest total weight (ties: smallest ids)."""
    p = p.sort_values([weight, "ref", "sec"], ascending=[False, True, True])
    ids, at = np.unique(np.concatenate([p["ref"], p["sec"]]), return_inverse=True)
    return p[preferred_forest(len(ids), at[: len(p)], at[len(p) :])]


def adaptive_threshold(scored: DataFrame, weight: str = "coh", share: float = 1.5) -> DataFrame:
    """(stack, threshold, n_kept, pixel_mask, count and range): the largest value that keeps share * (n - 1) pairs and one component.

    It is the smaller of the k-th largest weight and the weakest edge of the maximum spanning tree; rounded to three
    decimals downwards for the choice, to two for use; both counts are given.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        nodes = len(set(p["ref"]) | set(p["sec"]))
        tree = spanning_tree(p, weight)
        need = max(1, int(np.round(share * (nodes - 1))))
        values = np.sort(p[weight].to_numpy())[::-1]
        t = None
        if len(tree) == nodes - 1 and need <= len(values):
            t = float(np.floor(min(values[need - 1], tree[weight].min()) * 1000 + 1e-9) / 1000)
        use = None if t is None else round(t, 2)
        return pd.DataFrame({"stack": [p["stack"].iloc[0]], "threshold": [t], "n_kept": [0 if t is None else int((p[weight] >= t).sum())], "used": [use], "n_used": [0 if use is None else int((p[weight] >= use).sum())], "pixel_mask": [None if t is None else max(0.1, round(0.6 * t, 4))], "n_pairs": [len(p)], "lowest": [values[-1]], "highest": [values[0]], "median": [float(np.median(values))]})

    return scored.groupBy("stack").applyInPandas(run, "stack string, threshold double, n_kept long, used double, n_used long, pixel_mask double, n_pairs long, lowest double, highest double, median double")


def propagate_stack(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """Baselines of one stack by breadth first search from its first scene; pairs without a baseline are no path."""
    if s.empty:
        return pd.DataFrame({"stack": [], "scene": [], "bperp": [], "resolved": []})
    near: dict = {}
    for r, c, d in p[["ref", "sec", "signed"]].dropna().itertuples(index=False):
        near.setdefault(r, []).append((c, d))
        near.setdefault(c, []).append((r, -d))
    front = [s.sort_values(["t", "scene"])["scene"].iloc[0]]
    at = {front[0]: 0.0}
    while front:
        new = []
        for x in sorted(front):
            for to, d in near.get(x, ()):
                if to not in at:
                    at[to] = at[x] + d
                    new.append(to)
        front = new
    return pd.DataFrame({"stack": s["stack"], "scene": s["scene"], "bperp": [at.get(x, 0.0) for x in s["scene"]], "resolved": [x in at for x in s["scene"]]})


def propagated_baseline(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """(stack, scene, bperp, resolved): signed baselines summed along pairs from each stack's first scene.

    A scene takes the value of its smallest neighbour among those that fewer pairs reach. Scenes that no path reaches
    get 0 and resolved false. A group holds the pairs and scenes of one stack; chains may have any length.
    """
    with temporary(pairs.sparkSession) as keep:
        p, s = cut(pairs.select("stack", "ref", "sec", F.col("signed").cast("double").alias("signed"))), scenes.select("stack", "scene", "t")
        kind = dict(s.dtypes)
        found = p.groupBy("stack").cogroup(s.groupBy("stack")).applyInPandas(propagate_stack, f"stack {kind['stack']}, scene {kind['scene']}, bperp double, resolved boolean")
        return keep(found, "baselines")
