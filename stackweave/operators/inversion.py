"""Network inversion and time series of pixels.

Pixel tables hold one row per pixel and pair, or pixel and date. Kernels get batches of pixels with their values as
an array in a fixed order of pairs or dates; the design matrices are small and are sent along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import least_labels


def rates_design(n_dates: int, pairs: Sequence[tuple[int, int]], t: Sequence[float]) -> np.ndarray:
    """Pairs by intervals: the interval's length where the pair spans it."""
    d = np.zeros((len(pairs), n_dates - 1))
    dt = np.diff(np.asarray(t, float))
    for k, (i, j) in enumerate(pairs):
        d[k, i:j] = dt[i:j]
    return d


def solved_rates(pairs: Sequence[tuple[int, int]], y: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Rates of the intervals by normal equations, added up pair by pair over the few intervals that each spans."""
    m, b = np.zeros((len(dt), len(dt))), np.zeros(len(dt))
    for (i, j), v in zip(pairs, y.tolist()):
        d = dt[i:j]
        m[i:j, i:j] += d[:, None] * d
        b[i:j] += d * v
    return np.linalg.solve(m, b)


def date_corrections(shifts: DataFrame, schema_key: str = "stack") -> DataFrame:
    """Pair shifts (stack, t_ref, t_sec, shift, is_master on neither) -> corrections of dates, 0 at the first date.

    Rates of the intervals are the least-squares solution of least norm; summed, they give the dates' values. Failed
    (null) measurements are left out and counted. One group per stack: its pairs, a bounded number a date. The rank is
    the number of dates less that of their connected parts; with full rank the normal equations are solved.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        dates = np.array(sorted(set(p["t_ref"]) | set(p["t_sec"])))
        used = p[p["shift"].notna()]
        at = {d: i for i, d in enumerate(dates.tolist())}
        pairs = [(at[a], at[b]) for a, b in used[["t_ref", "t_sec"]].itertuples(index=False)]
        y, dt = used["shift"].to_numpy(float), np.diff(dates).astype(float)
        rank, rmse, rate = 0, None, np.zeros(len(dates) - 1)
        if len(pairs):
            rank = len(dates) - len(np.unique(least_labels(len(dates), *np.array(pairs).T)))
            rate = solved_rates(pairs, y, dt) if rank == len(dates) - 1 else np.linalg.lstsq(rates_design(len(dates), pairs, dates), y, rcond=None)[0]
            at_date = np.concatenate([[0.0], np.cumsum(rate * dt)])
            first, last = np.array(pairs).T
            rmse = float(np.sqrt(np.mean((at_date[last] - at_date[first] - y) ** 2)))
        value = np.concatenate([[0.0], np.cumsum(rate * np.diff(dates))])
        return pd.DataFrame({"stack": p["stack"].iloc[0], "t": dates, "correction": value, "rank": rank, "full_rank": rank == len(dates) - 1, "rmse": rmse, "n_used": len(used), "n_failed": len(p) - len(used)})

    return shifts.groupBy(schema_key).applyInPandas(run, "stack string, t long, correction double, rank long, full_rank boolean, rmse double, n_used long, n_failed long")


def applied(corrections: DataFrame, least: float = 1e-4) -> DataFrame:
    """Dates whose correction is to be applied: not the first, finite, not negligible."""
    first = F.min("t").over(Window.partitionBy("stack"))
    c = F.col("correction")
    return corrections.withColumn("use", (F.col("t") != first) & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.abs(c) >= least))


def weighted_rates(design: np.ndarray, root: np.ndarray, y: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Least-squares solutions of least norm of many pixels: rows of design and y times each pixel's root weights."""
    out = np.zeros((len(y), design.shape[1]))
    for i in range(0, len(y), at_once):
        r = root[i : i + at_once]
        out[i : i + at_once] = np.einsum("nkm,nm->nk", np.linalg.pinv(design * r[:, :, None]), y[i : i + at_once] * r)
    return out


def invert_pixels(phase: DataFrame, pairs: Sequence[tuple[int, int]], t: Sequence[float], weighted: bool = False, norm: str = "L2", iterations: int = 10) -> DataFrame:
    """(row, col, phase array<double>, weight array<double>) -> (row, col, n_used, coherence, date, value).

    Null phases are masked. Pixels with the same mask share one pseudo-inverse; with weights, or for the L1 norm (by
    reweighting), each has its own, taken of all pixels of a batch at once. ``coherence`` is |mean(exp(i residual))|.
    """
    full = rates_design(len(t), pairs, t)
    dt = np.diff(np.asarray(t, float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            y = np.array([np.array(v, float) for v in p["phase"]]).reshape(len(p), len(pairs))
            ok = ~np.isnan(y)
            rate = np.zeros((len(p), len(dt)))
            if weighted or norm == "L1":
                w0 = np.array([np.array(v, float) for v in p["weight"]]).reshape(y.shape) if weighted else np.ones(y.shape)
                w0, v = np.where(ok, w0, 0.0), np.nan_to_num(y)
                w = w0
                for _ in range(iterations if norm == "L1" else 1):
                    rate = weighted_rates(full, np.sqrt(w), v)
                    if norm == "L1":
                        w = w0 / np.maximum(np.abs(rate @ full.T - v), 1e-6)
            else:
                code = np.packbits(ok, axis=1)
                _, first, which = np.unique(code, axis=0, return_index=True, return_inverse=True)
                for k, f in enumerate(first):
                    own = np.flatnonzero(which.ravel() == k)
                    rate[own] = y[own][:, ok[f]] @ np.linalg.pinv(full[ok[f]]).T if ok[f].any() else 0
            res = np.where(ok, np.nan_to_num(y) - rate @ full.T, 0)
            n = ok.sum(1)
            coh = np.abs((np.exp(1j * res) * ok).sum(1)) / np.maximum(n, 1)
            value = np.concatenate([np.zeros((len(p), 1)), np.cumsum(rate * dt, axis=1)], axis=1)
            yield pd.DataFrame({"row": np.repeat(p["row"].to_numpy(), len(t)), "col": np.repeat(p["col"].to_numpy(), len(t)), "n_used": np.repeat(n, len(t)), "coherence": np.repeat(coh, len(t)), "t": np.tile(np.asarray(t, np.int64), len(p)), "value": value.ravel()})

    return phase.mapInPandas(run, "row long, col long, n_used long, coherence double, t long, value double")


#: Triplets up to which they are sent to the pixels.
TRIPLETS = 200_000
#: Pixels and triplets that are worked on at once.
CLOSED = 1 << 20


def closure_ambiguities(ifg: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pixel the triplets, and those whose closing phase holds a non-zero whole number of turns.

    ifg (ref, sec, row, col, phase) has a row per pair and pixel; one without a phase counts as missing, of rows that
    repeat the smallest phase counts, and pixels without a whole triplet have no row. A pixel's phases are brought
    together once, in the order of the pairs, and the network's triplets pick from them by place. Networks of more than
    TRIPLETS triplets are joined with the pixels instead.
    """
    names = pairs.select("ref", "sec").distinct()
    x, y, z = (names.select(F.col("ref").alias(a), F.col("sec").alias(b)) for a, b in (("a", "b"), ("b", "c"), ("a", "c")))
    triples = x.join(y, "b").join(z, ["a", "c"]).select("a", "b", "c")
    few = triples.limit(TRIPLETS + 1).toArrow()
    if len(few) > TRIPLETS:
        return closure_joined(ifg, triples)
    ends = [(few[p].to_pylist(), few[q].to_pylist()) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))]
    own = sorted({e for p, q in ends for e in zip(p, q)})
    place = {e: i for i, e in enumerate(own)}
    shared = ifg.sparkSession.sparkContext.broadcast(np.array([[place[e] for e in zip(p, q)] for p, q in ends], np.int64).reshape(3, -1))
    kinds = {f.name: f.dataType.simpleString() for f in ifg.schema}
    known = ifg.sparkSession.createDataFrame([(*e, i) for i, e in enumerate(own)], f"ref {kinds['ref']}, sec {kinds['sec']}, place int")
    phases = ifg.where("phase IS NOT NULL").join(F.broadcast(known), ["ref", "sec"])  # three pairs a triplet at most
    gathered = phases.groupBy("row", "col").agg(F.collect_list(F.struct("place", F.col("phase").cast("double").alias("phase"))).alias("p"))
    wide = gathered.select("row", "col", F.col("p.place").alias("place"), F.col("p.phase").alias("phase"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ab, bc, ac = shared.value
        step = max(1, CLOSED // max(1, len(own)))
        for whole in batches:
            for i in range(0, len(whole), step):
                b = whole.slice(i, step)
                pixel = np.repeat(np.arange(len(b)), b.column("place").value_lengths().to_numpy())
                phase = np.full((len(b), len(own)), np.nan)
                at, value = (pixel, b.column("place").flatten().to_numpy()), b.column("phase").flatten().to_numpy()
                np.fmin.at(phase, at, value)
                n, wrong = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                some = max(1, CLOSED // len(b))
                for j in range(0, len(ab), some):
                    t = slice(j, j + some)
                    turns = np.rint((phase[:, ab[t]] + phase[:, bc[t]] - phase[:, ac[t]]) / (2 * np.pi))
                    there = ~np.isnan(turns)
                    n += there.sum(1)
                    wrong += (there & (turns != 0)).sum(1)
                out = pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(n), pa.array(wrong)], ["row", "col", "n_triplets", "n_ambiguous"])
                yield out.filter(pa.array(n > 0))

    return wide.mapInArrow(run, f"row {kinds['row']}, col {kinds['col']}, n_triplets long, n_ambiguous long")


def closure_joined(ifg: DataFrame, triples: DataFrame) -> DataFrame:
    """closure_ambiguities() of triplets (a, b, c) of any number, by joins."""
    phases = ifg.where("phase IS NOT NULL AND NOT isnan(phase)").groupBy("ref", "sec", "row", "col").agg(F.min("phase").alias("phase"))
    side = lambda p, q, n: phases.select(F.col("ref").alias(p), F.col("sec").alias(q), "row", "col", F.col("phase").alias(n))
    closed = triples.join(side("a", "b", "ab"), ["a", "b"]).join(side("b", "c", "bc"), ["b", "c", "row", "col"]).join(side("a", "c", "ac"), ["a", "c", "row", "col"])
    turns = F.bround((F.col("ab") + F.col("bc") - F.col("ac")) / (2 * np.pi), 0)
    return closed.groupBy("row", "col").agg(F.count("*").alias("n_triplets"), F.sum((turns != 0).cast("int")).alias("n_ambiguous"))


def to_reference_point(ts: DataFrame, quality: DataFrame | None = None, least: float = 0.0, row: int | None = None, col: int | None = None) -> DataFrame:
    """Values less those of one pixel: the given one, else that of best quality over ``least`` (ties: smallest row, col)."""
    if row is None:
        best = quality.where(F.col("quality") >= least).agg(F.max_by(F.struct("row", "col"), F.struct("quality", -F.col("row"), -F.col("col"))).alias("p")).select("p.row", "p.col")
        own = ts.join(F.broadcast(best), ["row", "col"], "left_semi")
    else:
        own = ts.where((F.col("row") == row) & (F.col("col") == col))
    ref = own.select("t", F.col("value").alias("_ref"))  # one row a date
    return ts.join(F.broadcast(ref), "t").withColumn("value", F.col("value") - F.col("_ref")).drop("_ref")


def nearest_valid(quality: DataFrame, row: float, col: float, least: float = 0.0, ring: int = 4) -> tuple[int, int] | None:
    """(row, col) of the pixel of at least the given quality that is nearest to a place on the grid; None without any.

    Rings of cells around the place are read one after the other, each four times as wide, as ranges that reach the scan;
    a pixel is the nearest once it is no further off than the ring read. Ties: the smallest row, then column.
    """
    good = quality.where(F.col("quality") >= least)
    far = (F.col("row") - F.lit(float(row))) ** 2 + (F.col("col") - F.lit(float(col))) ** 2
    ends = good.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is None:
        return None
    widest = max(abs(ends[0] - row), abs(ends[1] - row), abs(ends[2] - col), abs(ends[3] - col))
    while True:
        near = good.where(F.col("row").between(int(np.floor(row - ring)), int(np.ceil(row + ring))) & F.col("col").between(int(np.floor(col - ring)), int(np.ceil(col + ring))))
        best = near.agg(F.min(F.struct(far.alias("far"), F.col("row"), F.col("col"))).alias("p")).first()["p"]
        if best is not None and (best["far"] <= ring * ring or ring >= widest):
            return int(best["row"]), int(best["col"])
        ring *= 4


def to_reference_place(ts: DataFrame, quality: DataFrame, grid: dict[str, float], lat: float, lon: float, least: float = 0.0) -> DataFrame:
    """Values less those of the valid pixel nearest to a latitude and longitude; grid has x0, y0, dx and dy of pixel centres."""
    found = nearest_valid(quality, (lat - grid["y0"]) / grid["dy"], (lon - grid["x0"]) / grid["dx"], least)
    if found is None:
        raise ValueError("no pixel is good enough for a reference")
    return to_reference_point(ts, row=found[0], col=found[1])


def to_reference_date(ts: DataFrame, t: int) -> DataFrame:
    """Values less the pixel's value on a date."""
    ref = ts.where(F.col("t") == t).select("row", "col", F.col("value").alias("_ref"))
    return ts.join(ref, ["row", "col"]).withColumn("value", F.col("value") - F.col("_ref")).drop("_ref")


def to_first_finite(ts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Values less the pixel's first that is finite, scaled."""
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    first = ts.groupBy("row", "col").agg(F.min_by(finite, F.when(finite.isNotNull(), F.col("t"))).alias("_ref"))
    return ts.join(first, ["row", "col"]).withColumn("value", (F.col("value") - F.col("_ref")) * scale).drop("_ref")


def fitted_surface(ts: DataFrame, terms: dict[str, str], by: str = "t") -> DataFrame:
    """(by, coefficients): least squares of value on SQL terms, per date, from sums of products.

    The sums are combined before their shuffle, so a date of any number of pixels is a row of numbers. The small
    systems are solved date by date. Terms should be of like size; see with_axes().
    """
    names = list(terms)
    base = ts.where("value IS NOT NULL").select(by, "value", *(F.expr(e).cast("double").alias(n) for n, e in terms.items()))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("value")).alias(f"{a}_v") for a in names]
    grams = base.groupBy(by).agg(*sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                m = np.array([[r.get(f"{a}_{b}", r.get(f"{b}_{a}")) for b in names] for a in names])
                out.append(np.linalg.lstsq(m, np.array([r[f"{a}_v"] for a in names]), rcond=None)[0])
            yield pd.DataFrame({by: p[by], **{n: [x[i] for x in out] for i, n in enumerate(names)}})

    kind = dict(ts.dtypes)[by]
    return grams.mapInPandas(run, f"{by} {kind}, " + ", ".join(f"{n} double" for n in names))


def without_surface(ts: DataFrame, terms: dict[str, str], mask: str = "true", how: str = "inner") -> DataFrame:
    """The surface fitted to the masked pixels of each date, taken from all. An offset must be among the terms.

    Dates without a masked pixel go, or with how = "left" stay as they are.
    """
    c = fitted_surface(ts.where(mask), terms).withColumnsRenamed({n: f"_{n}" for n in terms})
    fit = F.lit(0.0)
    for n, e in terms.items():
        fit = fit + F.coalesce(F.col(f"_{n}"), F.lit(0.0)) * F.expr(e)
    return ts.join(F.broadcast(c), "t", how).withColumn("value", F.col("value") - fit).drop(*(f"_{n}" for n in terms))  # one row a date


def with_axes(ts: DataFrame, **terms: str) -> DataFrame:
    """ts with terms moved and scaled to -1 to 1, so that their squares and products keep their digits over large grids."""
    ends = ts.agg(*(f(F.expr(e).cast("double")) for e in terms.values() for f in (F.min, F.max))).first()
    out = ts
    for i, (name, e) in enumerate(terms.items()):
        lo, hi = (x if x is not None else 0.0 for x in ends[2 * i : 2 * i + 2])
        out = out.withColumn(name, (F.expr(e) - (lo + hi) / 2) / ((hi - lo) / 2 or 1.0))
    return out


LINEAR = {"one": "1", "r": "axis_r", "c": "axis_c"}
QUADRATIC = {**LINEAR, "rr": "axis_r * axis_r", "cc": "axis_c * axis_c", "rc": "axis_r * axis_c"}


def deramped(ts: DataFrame, terms: dict[str, str] = LINEAR, mask: str = "true") -> DataFrame:
    """A plane or quadratic surface over rows and columns, fitted to each date's masked pixels, taken from all."""
    return without_surface(with_axes(ts, axis_r="row", axis_c="col"), terms, mask).drop("axis_r", "axis_c")


def without_height(ts: DataFrame, height: str, degree: int = 1, mask: str = "true", least: float = 0.0) -> DataFrame:
    """The part of each date that goes with a polynomial of the height, an SQL expression, taken out.

    A date whose values have a correlation with the height under ``least``, of either sign, is left as it is.
    """
    terms = {"one": "1", **{f"h{k}": " * ".join(["axis_h"] * k) for k in range(1, degree + 1)}}
    scaled = with_axes(ts, axis_h=height)
    if least <= 0:
        return without_surface(scaled, terms, mask).drop("axis_h")
    strong = scaled.where(mask).groupBy("t").agg((F.abs(F.corr("value", "axis_h")) >= least).alias("_strong"))
    marked = scaled.join(F.broadcast(strong), "t", "left")  # one row a date
    fitted = without_surface(marked, terms, f"({mask}) AND _strong", "left")
    return fitted.drop("axis_h", "_strong")


def phase_velocity(phase: DataFrame) -> DataFrame:
    """(row, col, velocity, n) of (row, col, dt_days, phase): sum of phases times years over sum of squared years."""
    years = F.col("dt_days") / 365.25
    ok = F.col("phase").isNotNull() & ~F.isnan("phase")
    return phase.where(ok).groupBy("row", "col").agg((F.sum(F.col("phase") * years) / F.sum(years * years)).alias("velocity"), F.count("*").alias("n"))


def residual_rms(residual: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Root mean square per date; outlying dates exceed cutoff times 1.4826 times the median over dates."""
    rms = residual.groupBy("t").agg(F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"))
    limit = rms.agg((F.median("rms") * 1.4826 * cutoff).alias("cut"))
    return rms.crossJoin(F.broadcast(limit)).select("t", "rms", (F.col("rms") > F.col("cut")).alias("outlier"))  # one row


def velocity(ts: DataFrame) -> DataFrame:
    """(row, col, velocity per year, intercept, its standard error, n) of a straight line in years."""
    years = F.col("t") / 365.25
    g = ts.where("value IS NOT NULL").groupBy("row", "col").agg(F.regr_slope("value", years).alias("velocity"), F.regr_intercept("value", years).alias("intercept"), F.count("*").alias("n"), F.regr_sxx("value", years).alias("sxx"), F.regr_syy("value", years).alias("syy"), F.regr_sxy("value", years).alias("sxy"))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"))
    return g.select("row", "col", "velocity", "intercept", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))).alias("velocity_std"), "n")


def time_functions(t: np.ndarray, poly: int = 1, periods: Sequence[float] = (), steps: Sequence[float] = (), exps: Sequence[tuple[float, float]] = (), logs: Sequence[tuple[float, float]] = ()) -> tuple[list[str], np.ndarray]:
    """(names, dates by functions) in years since the first date: powers, sines and cosines, steps, exp and log decays."""
    y = (t - t[0]) / 365.25
    cols = {f"poly{k}": y**k for k in range(poly + 1)}
    for p in periods:
        cols |= {f"sin{p:g}": np.sin(2 * np.pi * y / p), f"cos{p:g}": np.cos(2 * np.pi * y / p)}
    cols |= {f"step{s:g}": (t >= s).astype(float) for s in steps}
    after = lambda s: np.maximum(0, t - s)
    cols |= {f"exp{s:g}_{c:g}": np.where(t >= s, 1 - np.exp(-after(s) / c), 0) for s, c in exps}
    cols |= {f"log{s:g}_{c:g}": np.where(t >= s, np.log1p(after(s) / c), 0) for s, c in logs}
    return list(cols), np.stack(list(cols.values()), axis=1)


def used_dates(t: Sequence[float], start: float | None = None, end: float | None = None, exclude: Sequence[float] = ()) -> np.ndarray:
    """Which dates a fit uses: those from start to end (both included) that are not excluded."""
    t = np.asarray(t, float)
    return (t >= (-np.inf if start is None else start)) & (t <= (np.inf if end is None else end)) & ~np.isin(t, np.asarray(exclude, float))


def fitted_by_mask(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of least norm of each row of y, its nan left out; nan for rows without a value.

    Rows that lack the same dates share one pseudo-inverse.
    """
    ok = ~np.isnan(y)
    out = np.full((len(y), design.shape[1]), np.nan)
    _, first, which = np.unique(np.packbits(ok, axis=1), axis=0, return_index=True, return_inverse=True)
    for k, f in enumerate(first.tolist()):
        if ok[f].any():
            own = np.flatnonzero(which.ravel() == k)
            out[own] = y[own][:, ok[f]] @ np.linalg.pinv(design[ok[f]]).T
    return out


def values_of(p: pd.DataFrame, n: int, column: str = "values") -> np.ndarray:
    return np.array([np.array(v, float) for v in p[column]]).reshape(len(p), n)


def fit_series(series: DataFrame, t: Sequence[float], extra: Sequence[np.ndarray] = (), names: Sequence[str] = (), start: float | None = None, end: float | None = None, exclude: Sequence[float] = (), **functions) -> DataFrame:
    """(row, col, values array<double>) -> (row, col, name, coefficient): one shared design for all pixels.

    ``extra`` are further regressors over dates, such as baselines for the height error. Dates outside start to end and
    excluded ones are left out of the fit, and so are each pixel's own missing ones.
    """
    own, design = time_functions(np.asarray(t, float), **functions)
    own = [*own, *names]
    design = np.column_stack([design, *extra]) if len(extra) else design
    use = used_dates(t, start, end, exclude)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            c = fitted_by_mask(design[use], values_of(p, len(use))[:, use])
            yield pd.DataFrame({"row": np.repeat(p["row"].to_numpy(), len(own)), "col": np.repeat(p["col"].to_numpy(), len(own)), "name": own * len(p), "coefficient": c.ravel()})

    return series.mapInPandas(run, "row long, col long, name string, coefficient double")


def without_height_error(series: DataFrame, t: Sequence[float], bperp: Sequence[float], poly: int = 2, steps: Sequence[float] = (), exclude: Sequence[float] = (), by_velocity: bool = False) -> DataFrame:
    """(row, col, values, scale) -> (row, col, values, height_error): the part that goes with baselines taken out of a series.

    A date's regressor is bperp times the pixel's own scale (1 / (range * sin(incidence))), beside a polynomial and steps;
    it is fitted with those to the used dates, or by_velocity to the rates between them, and taken from all dates. A pixel
    with a scale of 0 or null has no height error and keeps its values.
    """
    _, design = time_functions(np.asarray(t, float), poly=poly, steps=steps)
    design = np.column_stack([np.asarray(bperp, float), design])
    use = used_dates(t, exclude=exclude)
    years = np.diff(np.asarray(t, float)[use])[:, None] / 365.25

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            y, scale = values_of(p, len(use)), p["scale"].to_numpy(float)
            d, v = design[use], y[:, use]
            if by_velocity:
                d, v = np.diff(d, axis=0) / years, np.diff(v, axis=1) / years.T
                d = d[:, np.abs(d).max(0) > 0]  # the offset has no rate
            slope = fitted_by_mask(d, v)[:, 0]
            known = np.isfinite(scale) & (scale != 0) & np.isfinite(slope)
            slope = np.where(known, slope, 0.0)
            out = y - slope[:, None] * np.asarray(bperp, float)
            error = np.divide(slope, scale, out=np.zeros(len(p)), where=known)
            yield pd.DataFrame({"row": p["row"], "col": p["col"], "values": list(out), "height_error": pd.Series(np.where(known, error, np.nan), index=p.index)})

    return series.select("row", "col", "values", "scale").mapInPandas(run, "row long, col long, values array<double>, height_error double")


def poisson_weights(keys: np.ndarray) -> np.ndarray:
    """How often each key is picked: Poisson with mean 1, from a 64-bit finaliser of the key."""
    x = keys.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7])), u, "right").astype(float)


def bootstrap_velocity(ts: DataFrame, replicates: int = 100, seed: int = 1) -> DataFrame:
    """(row, col, velocity_std, n): spread of slopes over dates resampled by hashes, the same in every run.

    Each date of a pixel counts in each replicate as often as its hash says, Poisson with mean 1. A pixel's dates are one
    array; a batch's sums are arrays of pixels by replicates, so that no row is made for a replicate.
    """
    point = F.struct("t", F.col("value").cast("double").alias("y"))
    pixel = ts.where("value IS NOT NULL").groupBy("row", "col").agg(F.sort_array(F.collect_list(point)).alias("p"))
    pixel = pixel.select("row", "col", F.xxhash64(F.lit(seed), "row", "col").alias("h"), F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["y"]).alias("y"))
    rep = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                n = b.column("t").value_lengths().to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)[:-1]])
                t, y = b.column("t").flatten().to_numpy().astype(float), b.column("y").flatten().to_numpy()
                x = t / 365.25
                own = np.repeat(b.column("h").to_numpy().view(np.uint64), n) + t.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95)
                w = poisson_weights(own[:, None] ^ rep[None, :])
                total = lambda v: np.add.reduceat(w * v[:, None], at, axis=0)
                one, sx, sy, sxx, sxy = (total(v) for v in (np.ones(len(x)), x, y, x * x, x * y))
                det = one * sxx - sx * sx
                ok = det > 1e-12
                slope = np.where(ok, (one * sxy - sx * sy) / np.where(ok, det, 1), 0.0)
                m = ok.sum(1)
                mean = slope.sum(1) / np.maximum(m, 1)
                std = np.sqrt((np.where(ok, slope - mean[:, None], 0) ** 2).sum(1) / np.maximum(m - 1, 1))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(std, mask=m < 2), pa.array(m.astype(np.int64))], ["row", "col", "velocity_std", "n"])

    return pixel.mapInArrow(run, "row long, col long, velocity_std double, n long")
