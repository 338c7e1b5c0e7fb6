"""Registered queries: inversions with weights from coherence, masks, fits with dates left out, references by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inversion as I
from ..operators import weights as W
from .adapters import WITH, pixels
from .pixels import CUBE, NETWORK, T_DATES, phases, series, with_cube
from .registry import query

LOOKS = 6


def coherent_phases(spark: SparkSession, folder: str) -> DataFrame:
    """phases() with a coherence for each pair, some missing."""
    value = lambda k: F.when(F.pmod(F.col("row") + F.col("col") * 5 + k, F.lit(17)) != 0, 0.05 + F.pmod(F.col("row") * 3 + F.col("col") * 7 + k * 11, F.lit(90)) / 100.0)
    return phases(spark, folder).drop("weight").withColumn("coherence", F.array(*(value(k) for k in range(len(NETWORK)))))


PHASES = f"""{CUBE}, pairs AS (SELECT row, col, k, {list(j - i for i, j in NETWORK)}[k + 1] AS n,
CASE WHEN (row * 7 + col * 3 + k) % 13 <> 0 THEN v / 100000.0::DOUBLE * {[T_DATES[j] - T_DATES[i] for i, j in NETWORK]}[k + 1] + CASE WHEN (row + col + k) % 29 = 0 THEN 2 * pi() ELSE 0 END END AS phase,
CASE WHEN (row + col * 5 + k) % 17 <> 0 THEN 0.05 + (row * 3 + col * 7 + k * 11) % 90 / 100.0::DOUBLE END AS coh FROM cube, range({len(NETWORK)}) r(k))
"""


def inverted(spark: SparkSession, folder: str, kind: str, norm: str = "L2") -> DataFrame:
    ts = I.invert_pixels(W.weighted(coherent_phases(spark, folder), kind, LOOKS), NETWORK, T_DATES, weighted=kind != "no", norm=norm)
    return ts.select("row", "col", "n_used", "t", F.round("value", 6).alias("value"))


@query()
def inversion_by_variance(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares weighted by the inverse of the phase's variance, from coherence and looks."""
    return inverted(spark, folder, "var")


@query()
def inversion_by_fisher(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares weighted by Fisher information."""
    return inverted(spark, folder, "fim")


@query()
def inversion_least_absolute(spark: SparkSession, folder: str) -> DataFrame:
    """The L1 norm, by reweighting."""
    return inverted(spark, folder, "no", "L1")


@query(WITH + PHASES + f"SELECT row, col, CAST(k AS BIGINT) AS pair, round(CASE WHEN coh IS NULL THEN 0 ELSE 2.0 * {LOOKS} * least(greatest(coh, 0.001), 0.999) ** 2 / (1 - least(greatest(coh, 0.001), 0.999) ** 2) END, 6) AS weight, CASE WHEN coh IS NOT NULL THEN round(phase, 6) END AS phase FROM pairs")
def inversion_fisher_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair's Fisher information and the phases that have one."""
    w = W.weighted(coherent_phases(spark, folder), "fim", LOOKS)
    each = w.select("row", "col", F.posexplode(F.arrays_zip("phase", "weight")).alias("pair", "x"))
    return each.select("row", "col", F.col("pair").cast("long").alias("pair"), F.round("x.weight", 6).alias("weight"), F.round("x.phase", 6).alias("phase"))


@query(WITH + PHASES + "SELECT row, col, count(phase) AS n, round(sum(phase), 5) AS total FROM (SELECT row, col, CASE WHEN coh >= 0.3 THEN phase END AS phase FROM pairs WHERE (row + col) % 6 <> 0 AND (row * col) % 11 <> 3) GROUP BY row, col HAVING count(phase) >= 3")
def inversion_masked(spark: SparkSession, folder: str) -> DataFrame:
    """phases under a coherence, water and shadow masked before an inversion, pixels with too few left out."""
    p = coherent_phases(spark, folder)
    water = p.select("row", "col", F.when((F.col("row") + F.col("col")) % 6 != 0, 1).otherwise(0).alias("valid"))
    shadow = p.select("row", "col", F.when(F.col("row") * F.col("col") % 11 == 3, 1).otherwise(0).alias("shadow"))
    got = W.masked(p, 0.3, water, shadow, 3)
    known = F.filter("phase", lambda x: x.isNotNull())
    return got.select("row", "col", F.size(known).cast("long").alias("n"), F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query()
def inversion_coherent(spark: SparkSession, folder: str) -> DataFrame:
    """An inversion of masked phases, pixels under a temporal coherence left out."""
    ts = I.invert_pixels(W.masked(coherent_phases(spark, folder), 0.3, least=4), NETWORK, T_DATES)
    return W.coherent(ts, 0.9).select("row", "col", "n_used", F.round("coherence", 6).alias("coherence"), "t", F.round("value", 6).alias("value"))


def arrays(spark: SparkSession, folder: str, odd: bool = True) -> DataFrame:
    """(row, col, values): series() as arrays in order of date; with ``odd`` some pixels lack a date."""
    s = series(spark, folder)
    if odd:
        s = s.withColumn("value", F.when(F.pmod(F.col("row") + F.col("t"), F.lit(7)) != 0, F.col("value")))
    return s.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))


ODD = "CASE WHEN (row + t) % 7 <> 0 THEN value END"


@query(with_cube(f"SELECT row, col, round(regr_slope({ODD}, t / 365.25::DOUBLE), 8) AS velocity, round(regr_intercept({ODD}, t / 365.25::DOUBLE), 4) AS intercept FROM ts WHERE t <= 48 AND t <> 24 GROUP BY row, col HAVING count({ODD}) >= 2"))
def series_velocity_of_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A line through the dates of a range without an excluded one, and without each pixel's missing ones."""
    a = arrays(spark, folder).where(F.size(F.filter(F.array(*(F.get("values", F.lit(k)) for k in (0, 1, 3))), lambda v: v.isNotNull())) >= 2)
    got = I.fit_series(a, T_DATES, end=48, exclude=[24], poly=1)
    c = got.groupBy("row", "col").agg(*(F.max(F.when(F.col("name") == n, F.col("coefficient"))).alias(n) for n in ("poly0", "poly1")))
    return c.select("row", "col", F.round("poly1", 8).alias("velocity"), F.round("poly0", 4).alias("intercept"))


def with_term(term: str) -> str:
    return with_cube(f"SELECT row, col, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x), 4) AS level FROM (SELECT *, CASE WHEN t >= 12 THEN {term} ELSE 0 END AS x FROM ts) GROUP BY row, col")


def of_term(spark: SparkSession, folder: str, name: str, **terms) -> DataFrame:
    got = I.fit_series(arrays(spark, folder, False), T_DATES, poly=0, **terms)
    c = got.groupBy("row", "col").agg(F.max(F.when(F.col("name") == name, F.col("coefficient"))).alias("slope"), F.max(F.when(F.col("name") == "poly0", F.col("coefficient"))).alias("level"))
    return c.select("row", "col", F.round("slope", 4).alias("slope"), F.round("level", 4).alias("level"))


@query(with_term("1 - exp(-(t - 12) / 30.0::DOUBLE)"))
def series_exponential(spark: SparkSession, folder: str) -> DataFrame:
    """An exponential decay after an event, and a level."""
    return of_term(spark, folder, "exp12_30", exps=[(12, 30)])


@query(with_term("ln(1 + (t - 12) / 20.0::DOUBLE)"))
def series_logarithm(spark: SparkSession, folder: str) -> DataFrame:
    """A logarithmic decay after an event, and a level."""
    return of_term(spark, folder, "log12_20", logs=[(12, 20)])


@query()
def series_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """A line and a period of a tenth of a year; pixels without a date have fits of least norm."""
    got = I.fit_series(arrays(spark, folder), T_DATES, poly=1, periods=[0.1])
    return got.select("row", "col", "name", F.round("coefficient", 5).alias("coefficient"))


#: Baselines with mean 0, so that with a level alone (poly = 0) the height error is a plain slope.
BPERP = [0.0, 30.0, -45.0, 10.0, 5.0]


@query(with_cube(f"SELECT row, col, t, round(value - s * b, 4) + 0.0 AS value, round(s / (0.001 + col % 3 / 1000.0), 2) AS height_error FROM (SELECT *, {BPERP}[list_position({T_DATES}, t)] AS b FROM ts) JOIN (SELECT row, col, regr_slope(value, b) AS s FROM (SELECT row, col, t, value, {BPERP}[list_position({T_DATES}, t)] AS b FROM ts WHERE t <> 60) GROUP BY row, col) USING (row, col)"))
def series_height_error(spark: SparkSession, folder: str) -> DataFrame:
    """The height error by baselines with each pixel's own geometry, one date left out of the fit, taken from all dates."""
    a = arrays(spark, folder, False).withColumn("scale", 0.001 + F.col("col") % 3 / 1000.0)
    got = I.without_height_error(a, T_DATES, BPERP, poly=0, exclude=[60])
    each = got.select("row", "col", F.posexplode("values").alias("k", "value"), "height_error")
    return each.select("row", "col", F.element_at(F.array(*map(F.lit, T_DATES)), F.col("k") + 1).alias("t"), (F.round("value", 4) + 0.0).alias("value"), F.round("height_error", 2).alias("height_error"))


@query(with_cube("SELECT row, col, t, round(value - CASE WHEN abs(r) >= 0.5 THEN i + s * (row * 10 + col % 5) ELSE 0 END, 5) + 0.0 AS value FROM ts JOIN (SELECT t, corr(value, row * 10 + col % 5) AS r, regr_intercept(value, row * 10 + col % 5) AS i, regr_slope(value, row * 10 + col % 5) AS s FROM ts GROUP BY t) USING (t)"))
def series_height_correlated_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The part that goes with height taken from the dates that are correlated with it enough, others as they are."""
    return I.without_height(series(spark, folder), "row * 10 + col % 5", least=0.5).select("row", "col", "t", (F.round("value", 5) + 0.0).alias("value"))


@query(with_cube("SELECT row, col, t, round(value - first_value(value) OVER (PARTITION BY t ORDER BY CASE WHEN quality >= 0.97 THEN (row - 33.3) ** 2 + (col - 41.25) ** 2 ELSE 1e18 END, row, col), 6) + 0.0 AS value FROM ts"))
def series_reference_place(spark: SparkSession, folder: str) -> DataFrame:
    """I8: values less those of the good pixel nearest to a latitude and longitude that lies among poor ones."""
    ts = series(spark, folder)
    q = ts.where("t = 0").select("row", "col", "quality")
    grid = {"x0": -120.0, "y0": 40.0, "dx": 0.5, "dy": -0.5}
    return I.to_reference_place(ts, q, grid, 40 - 33.3 * 0.5, -120 + 41.25 * 0.5, 0.97).select("row", "col", "t", F.round("value", 6).alias("value"))
