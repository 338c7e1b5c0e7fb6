"""Seasonal coherence: segments of a pair's span by season, the decay model, chained and per-pixel coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import decay, season

STEPS = 40
NO_FIT = (0.0, 1.0, 30.0)
#: A line falls if its slope is under this; equal values have a slope of some rounding error.
FALLING = -1e-12
# Climatological coherence by band of latitude (from 0, 10, ... 80), season, and lags 6, 12, 18, 24, 36, 48.
SEASON_ORDER = ("winter", "spring", "summer", "fall")
CLIMATOLOGY_LAGS = (6, 12, 18, 24, 36, 48)
CLIMATOLOGY = (
    (0, (0.38, 0.28, 0.22, 0.18, 0.14, 0.11), (0.36, 0.27, 0.21, 0.17, 0.13, 0.10), (0.35, 0.26, 0.20, 0.16, 0.12, 0.10), (0.37, 0.27, 0.21, 0.17, 0.13, 0.11)),
    (10, (0.45, 0.34, 0.27, 0.22, 0.17, 0.14), (0.42, 0.31, 0.25, 0.20, 0.16, 0.13), (0.38, 0.28, 0.22, 0.18, 0.14, 0.11), (0.43, 0.32, 0.25, 0.20, 0.16, 0.13)),
    (20, (0.58, 0.47, 0.39, 0.33, 0.26, 0.21), (0.55, 0.44, 0.36, 0.30, 0.24, 0.19), (0.50, 0.39, 0.32, 0.26, 0.20, 0.17), (0.54, 0.43, 0.35, 0.29, 0.23, 0.18)),
    (30, (0.52, 0.41, 0.33, 0.27, 0.21, 0.17), (0.48, 0.37, 0.30, 0.24, 0.19, 0.15), (0.60, 0.49, 0.41, 0.34, 0.27, 0.22), (0.57, 0.46, 0.38, 0.31, 0.25, 0.20)),
    (40, (0.48, 0.36, 0.29, 0.23, 0.18, 0.14), (0.45, 0.34, 0.27, 0.22, 0.17, 0.13), (0.55, 0.43, 0.35, 0.29, 0.23, 0.18), (0.58, 0.46, 0.38, 0.31, 0.25, 0.20)),
    (50, (0.44, 0.32, 0.25, 0.20, 0.15, 0.12), (0.40, 0.29, 0.23, 0.18, 0.14, 0.11), (0.47, 0.36, 0.28, 0.23, 0.18, 0.14), (0.50, 0.38, 0.30, 0.25, 0.19, 0.15)),
    (60, (0.38, 0.27, 0.21, 0.17, 0.13, 0.10), (0.35, 0.25, 0.19, 0.15, 0.12, 0.09), (0.40, 0.30, 0.23, 0.19, 0.15, 0.12), (0.42, 0.31, 0.24, 0.20, 0.15, 0.12)),
    (70, (0.32, 0.22, 0.17, 0.14, 0.10, 0.08), (0.30, 0.21, 0.16, 0.13, 0.10, 0.08), (0.35, 0.25, 0.19, 0.16, 0.12, 0.10), (0.33, 0.23, 0.18, 0.14, 0.11, 0.09)),
    (80, (0.28, 0.19, 0.14, 0.11, 0.09, 0.07), (0.28, 0.19, 0.14, 0.11, 0.09, 0.07), (0.30, 0.21, 0.16, 0.13, 0.10, 0.08), (0.29, 0.20, 0.15, 0.12, 0.09, 0.07)),
)


def climatology(spark) -> DataFrame:
    """(band, season, lag, coh)"""
    rows = [(band, s, lag, c) for band, *values in CLIMATOLOGY for s, row in zip(SEASON_ORDER, values) for lag, c in zip(CLIMATOLOGY_LAGS, row)]
    return spark.createDataFrame(rows, "band int, season string, lag int, coh double")


def band_of(lat: Column) -> Column:
    return F.least(F.floor(F.abs(lat) / 10) * 10, F.lit(80)).cast("int")


def season_segments(d1: Column, d2: Column, lat: Column) -> Column:
    """array<struct<days, season>> of the span, cut at the first days of March, June, September and December."""
    months = F.sequence(F.trunc(d1, "month"), d2, F.expr("INTERVAL 1 MONTH"))
    cuts = F.filter(months, lambda m: F.month(m).isin(3, 6, 9, 12) & (m > d1) & (m < d2))
    starts, stops = F.concat(F.array(d1), cuts), F.concat(cuts, F.array(d2))
    spans = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.struct(F.greatest(F.datediff(x["b"], x["a"]), F.lit(1)).alias("days"), season(F.month(x["a"]), lat, fall=True).alias("season")))
    return spans


def fit(lag: np.ndarray, coh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g_inf, g0, tau) of each row of coh (n, len(lag)); nan where a lag is missing, three are needed.

    For each of STEPS floors between 0 and .95 of the least coherence a line is fitted to the logarithm of what
    is above the floor; the floor with the least squared error is taken. Only falling lines count.
    """
    n = len(coh)
    out = tuple(np.full(n, v) for v in NO_FIT)
    valid = ~np.isnan(coh)
    best = np.full(n, np.inf)
    usable = valid.sum(1) >= 3
    least = np.where(usable, np.nanmin(np.where(valid, coh, np.inf), axis=1), np.nan)
    w = valid.astype(float)
    k = w.sum(1)
    tm = np.where(k > 0, (w * lag).sum(1) / np.maximum(k, 1), 0)
    tc = (lag - tm[:, None]) * w
    ss = (tc**2).sum(1)
    for step in range(STEPS):
        g = least * 0.95 * step / (STEPS - 1)
        y = coh - g[:, None]
        ok = usable & np.all(np.where(valid, y > 0, True), axis=1)
        with np.errstate(all="ignore"):
            logs = np.where(valid, np.log(np.where(y > 0, y, 1)), 0)
            mean = logs.sum(1) / k
            slope = (tc * (logs - mean[:, None])).sum(1) / ss
            a = np.exp(mean - slope * tm)
            err = (np.where(valid, g[:, None] + a[:, None] * np.exp(slope[:, None] * lag) - coh, 0) ** 2).sum(1) / k
        take = ok & (slope < FALLING) & (err < best)
        best[take] = err[take]
        for o, v in zip(out, (g, np.minimum(g + a, 1.0), -1 / np.where(slope < 0, slope, -1))):
            o[take] = v[take]
    return out


def fit_pixels(levels: DataFrame, keys: list[str], lags: tuple[int, ...]) -> DataFrame:
    """levels (keys, lag, coh) -> (keys, n_lags, g_inf, g0, tau) of all keys, fitted a batch at a time."""
    wide = levels.groupBy(*keys).agg(*(F.max(F.when(F.col("lag") == t, F.col("coh"))).cast("double").alias(f"c{t}") for t in lags))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            coh = p[[f"c{t}" for t in lags]].to_numpy(float)
            g, a, tau = fit(np.array(lags, float), coh)
            out = p[keys].copy()
            out["n_lags"], out["g_inf"], out["g0"], out["tau"] = (~np.isnan(coh)).sum(1), g, a, tau
            yield out

    fields = ", ".join(f"{c} {t}" for c, t in wide.select(*keys).dtypes)
    return wide.mapInPandas(run, f"{fields}, n_lags long, g_inf double, g0 double, tau double")


def season_days(scenes: DataFrame, lat: Column) -> DataFrame:
    """scenes with before (days of each season of SEASON_ORDER before the scene's day) and cuts (seasons begun by then).

    Each day of a span has one season, so what a span has of each is the difference of two scenes' columns: no span is
    cut into segments, and a pair is a row of numbers. The calendar is a row a day and half of the globe.
    """
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int"))
    scenes = scenes.withColumn("_south", lat < 0)
    ends = scenes.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("t")).crossJoin(F.broadcast(scenes.sparkSession.createDataFrame([(False,), (True,)], "_south boolean")))  # two rows
    own = days.withColumn("s", season(F.month(day("t")), F.when(F.col("_south"), -1.0).otherwise(1.0), fall=True))
    before = Window.partitionBy("_south").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.dayofmonth(day("t")) == 1) & F.month(day("t")).isin(3, 6, 9, 12)
    count = lambda c: F.coalesce(F.sum(c.cast("long")).over(before), F.lit(0))
    known = own.select("t", "_south", F.array(*(count(F.col("s") == s) for s in SEASON_ORDER)).alias("before"), count(start).alias("cuts"), start.alias("begins"))
    return scenes.join(F.broadcast(known), ["t", "_south"]).drop("_south")  # two rows a day of the span


SEASON_COLUMNS = ("before", "cuts", "begins")


def days_of(i: int) -> Column:
    return F.get("before_sec", F.lit(i)) - F.get("before_ref", F.lit(i))


def chained(pairs: DataFrame, params: DataFrame, keys: list[str], on: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """(keys, coh, floor, n_segments) of pairs that carry SEASON_COLUMNS of both ends; null if a season lacks parameters.

    Floors and starts are means weighted by days, decays add up. params: (season, g_inf, g0, tau), or a row for each
    season and ``on``, such as a band of latitude, which pairs have too.
    """
    value = lambda s, c: F.max(F.when(F.col("season") == s, F.col(c))).alias(f"{s}_{c}")
    wide = params.groupBy(*on).agg(*(value(s, c) for s in SEASON_ORDER for c in ("g_inf", "g0", "tau")))
    got = pairs.join(F.broadcast(wide), list(on), "left") if on else pairs.crossJoin(F.broadcast(wide))  # one row, or one a band
    total = {c: F.lit(0.0) for c in ("days", "g_inf", "g0", "decay")}
    whole = F.lit(True)
    for i, s in enumerate(SEASON_ORDER):
        d = days_of(i)
        used = lambda x, d=d: F.when(d > 0, x).otherwise(0.0)
        total["days"] = total["days"] + d
        total["g_inf"] = total["g_inf"] + used(d * F.col(f"{s}_g_inf"))
        total["g0"] = total["g0"] + used(d * F.col(f"{s}_g0"))
        total["decay"] = total["decay"] + used(d / F.col(f"{s}_tau"))
        whole = whole & ((d == 0) | F.col(f"{s}_tau").isNotNull())
    sums = got.select(*keys, *(x.alias(c) for c, x in total.items()), whole.alias("whole"), (1 + F.col("cuts_sec") - F.col("cuts_ref") - F.col("begins_ref").cast("long")).alias("n_segments"))
    ginf, g0 = F.col("g_inf") / F.col("days"), F.col("g0") / F.col("days")
    coh = ginf + (g0 - ginf) * F.exp(-F.col("decay"))
    return sums.select(*keys, F.when(F.col("whole"), F.round(coh, digits)).alias("coh"), F.when(F.col("whole"), F.round(ginf, digits)).otherwise(0.0).alias("floor"), "n_segments")


#: Pixels and quadruples of days that are worked on at once: a block of them fits a processor's cache.
PIXELS, QUADRUPLES = 1024, 64


def pixel_chained(pairs: DataFrame, maps: DataFrame, keys: list[str], pixel: list[str]) -> DataFrame:
    """Per pair the mean over pixels (season, pixel, g_inf, g0, tau) that are valid in all its seasons.

    Pairs with the same days of each season have the same mean. The distinct quadruples of days, whose number the
    longest interval bounds, are sent to all batches of pixels, whose sums are added up: no pair meets a pixel. What
    a pixel keeps after so many days of a season is worked out once and shared by all quadruples that have them; pairs
    without a day between are left out.
    """
    names = ["d0", "d1", "d2", "d3"]
    spans = pairs.select(*keys, *(days_of(i).cast("int").alias(n) for i, n in enumerate(names)))
    distinct = spans.select(*names).distinct().toArrow()  # at most a longest interval's square a season
    days = np.stack([distinct[n].to_numpy() for n in names], axis=1).astype(float).reshape(-1, 4)
    shared = maps.sparkSession.sparkContext.broadcast(days)
    value = lambda s, c: F.max(F.when(F.col("season") == s, F.col(c))).cast("double").alias(f"{s}_{c}")
    wide = maps.groupBy(*pixel).agg(*(value(s, c) for s in SEASON_ORDER for c in ("g_inf", "g0", "tau")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = shared.value
        sums = np.zeros((len(d), 3))
        lengths = [np.unique(d[:, i], return_inverse=True) for i in range(len(SEASON_ORDER))]
        # quadruples with days in the same seasons, and the share that each season has of their days
        seasons, kind = np.unique(d > 0, axis=0, return_inverse=True)
        kinds = [(np.flatnonzero(used), np.flatnonzero(kind == k)) for k, used in enumerate(seasons) if used.any()]
        for p in batches:
            g_inf, g0, tau = (np.stack([p[f"{s}_{c}"].to_numpy(float) for s in SEASON_ORDER]) for c in ("g_inf", "g0", "tau"))
            for i in range(0, len(p), PIXELS):
                floor, start, t = g_inf[:, i : i + PIXELS], g0[:, i : i + PIXELS], tau[:, i : i + PIXELS]
                known = ~np.isnan(t)
                left = [np.exp(-days[:, None] / np.where(known[k], t[k], np.inf)) for k, (days, _) in enumerate(lengths)]
                for used, rows in kinds:
                    at = known[used].all(0)
                    low, rise = floor[np.ix_(used, at)], (start - floor)[np.ix_(used, at)]
                    share = d[np.ix_(rows, used)] / d[rows].sum(1, keepdims=True)
                    base = share @ low.sum(1)
                    sums[rows, 1] += base
                    sums[rows, 2] += at.sum()
                    kept = [left[k][:, at] for k in used]
                    place = [lengths[k][1][rows] for k in used]
                    if len(used) == 1:
                        sums[rows, 0] += base + (kept[0] @ np.maximum(rise[0], 0))[place[0]]
                        continue
                    for j in range(0, len(rows), QUADRUPLES):
                        r = slice(j, j + QUADRUPLES)
                        above = np.maximum(share[r] @ rise, 0)
                        for e, n in zip(kept[1:], place[1:]):
                            above *= e[n[r]]
                        sums[rows[r], 0] += base[r] + np.einsum("ij,ij->i", above, kept[0][place[0][r]])
        own = np.flatnonzero(sums[:, 2])
        yield pd.DataFrame({**{k: d[own, i].astype(np.int32) for i, k in enumerate(names)}, "c": sums[own, 0], "f": sums[own, 1], "n": sums[own, 2].astype(np.int64)})

    n = F.sum("n")
    means = wide.mapInPandas(run, "d0 int, d1 int, d2 int, d3 int, c double, f double, n long").groupBy(*names).agg(F.round(F.sum("c") / n, 4).alias("coh"), F.round(F.sum("f") / n, 4).alias("floor"), n.alias("n_pixels"))
    return spans.join(means, names).select(*keys, "coh", "floor", "n_pixels")


def evaluate(maps: DataFrame, dt: float) -> DataFrame:
    """Mean coherence and floor of the maps of each season at an interval."""
    c = decay(F.col("g_inf"), F.col("g0"), F.col("tau"), F.lit(float(dt)))
    return maps.groupBy("season").agg(F.avg(c).alias("coh"), F.avg("g_inf").alias("floor"), F.count("*").alias("n"))


def map_statistics(maps: DataFrame) -> DataFrame:
    """Per season and polarization the valid pixels and the mean, least and most of each parameter, in one pass."""
    stats = [f(F.when(F.col("valid"), F.col(c))).alias(f"{c}_{n}") for c in ("g_inf", "g0", "tau") for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))]
    return maps.groupBy("season", "pol").agg(F.count(F.when(F.col("valid"), True)).alias("n_valid"), F.count("*").alias("n"), *stats)


def covers(maps: DataFrame, row: int, col: int) -> DataFrame:
    """Seasons whose stored map's extent holds the point; others are stale for it."""
    e = maps.groupBy("season").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return e.where(F.lit(row).between(F.col("r0"), F.col("r1")) & F.lit(col).between(F.col("c0"), F.col("c1"))).select("season")


# Land-cover codes by how coherence behaves over them.
CLASS_GROUPS = {"stable": (50, 60), "vegetation": (20, 30, 40), "forest": (10, 95), "water": (80, 90)}
LEAST_PIXELS = 30


def class_group(cls: Column) -> Column:
    """The group of a land-cover code, null for others."""
    out = F.lit(None).cast("string")
    for group, codes in CLASS_GROUPS.items():
        out = F.when(cls.isin(*codes), group).otherwise(out)
    return out


def levels_by_class(coherence: DataFrame, classes: DataFrame, least: int = LEAST_PIXELS) -> DataFrame:
    """(season, group, lag, coh, n): mean coherence (0 to 1) of valid pixels by class group, where there are ``least``.

    coherence: (season, lag, row, col, coh 0 to 100), 0 and 255 not valid; classes: (row, col, cls), the most frequent
    class of each coherence cell, as pixels.majority() gives it.
    """
    known = classes.select("row", "col", class_group(F.col("cls")).alias("group")).where("group IS NOT NULL")
    found = coherence.where("coh > 0 AND coh < 255").join(known, ["row", "col"]).groupBy("season", "group", "lag")
    return found.agg((F.avg("coh") / 100).alias("coh"), F.count("*").alias("n")).where(F.col("n") >= least)
