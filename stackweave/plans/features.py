"""Registered queries: date features, pair features, quality scores and the coherence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..functions import scores as Q
from ..operators import coherence as K
from ..operators import features as E
from ..operators import pairs as P
from .adapters import LEVELS, WITH, collapsed, latitude, samples, site_days, table
from .registry import query

# pair features: days of a site up to 12 apart, with land cover, vegetation and baselines derived from the keys
PAIRS = """, sums AS (
  SELECT *, sum(precip) OVER (PARTITION BY site ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS precip_3day, sum(precip) OVER (PARTITION BY site ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS precip_7day, (month(day) + CASE WHEN site % 190 < 95 THEN 6 ELSE 0 END) % 12 // 3 AS season FROM site_days
), fv AS (
  SELECT a.site, a.t AS t_d1, b.t AS t_d2, b.t - a.t AS dt, a.temp AS temp_max_d1, b.temp AS temp_max_d2, a.snow AS snow_cover_frac_d1, b.snow AS snow_cover_frac_d2,
    CAST(a.precip AS DOUBLE) AS precip_d1, CAST(b.precip AS DOUBLE) AS precip_d2, CAST(a.precip_3day AS DOUBLE) AS precip_3day_d1, CAST(b.precip_3day AS DOUBLE) AS precip_3day_d2, CAST(a.precip_7day AS DOUBLE) AS precip_7day_d1, CAST(b.precip_7day AS DOUBLE) AS precip_7day_d2,
    CAST(least((b.t - a.t) / 180.0, 1) AS DOUBLE) AS dt_normalized, greatest(0, least(1, (CAST((a.site * 37 + a.t * 13) % 900 AS DOUBLE) - 150) / 650)) AS bperp_normalized, CAST((a.site * 37 + a.t * 13) % 900 AS DOUBLE) AS bperp,
    round_even(abs(a.snow - b.snow), 4) AS delta_snow_cover, coalesce(CAST((a.temp < 0) <> (b.temp < 0) AS INT), 0) AS freeze_thaw,
    CAST((a.site + a.t) % 10 AS DOUBLE) / 10 AS ndvi_d1, CAST((a.site + b.t) % 10 AS DOUBLE) / 10 AS ndvi_d2,
    greatest(CAST((a.site + a.t) % 10 AS DOUBLE) / 10, CAST((a.site + b.t) % 10 AS DOUBLE) / 10) * CAST(least((b.t - a.t) / 180.0, 1) AS DOUBLE) AS veg_temporal,
    CAST(CASE (a.season - b.season + 4) % 4 WHEN 0 THEN 0 WHEN 2 THEN CASE WHEN a.season % 2 = 0 THEN 0.95 ELSE 0.70 END ELSE 0.35 END AS DOUBLE) AS season_penalty, CAST(len(list_filter([1, 2, 3, 4, 5], lambda n: abs(b.t - a.t - n * 365) <= 20)) > 0 AS INT) AS is_annual_repeat,
    CAST(a.site % 5 AS DOUBLE) / 10 AS lc_forest_fraction, CAST(a.site % 3 AS DOUBLE) / 10 AS lc_urban_fraction, CAST(a.site % 2 AS DOUBLE) / 10 AS lc_bare_fraction, CAST(a.site % 4 AS DOUBLE) / 10 AS lc_crop_fraction, CAST(0.1 AS DOUBLE) AS lc_grass_fraction, CAST(a.site % 2 AS DOUBLE) / 5 AS lc_shrub_fraction,
    CAST(a.site % 7 AS DOUBLE) / 10 AS lc_water_fraction, CAST(a.site % 11 AS DOUBLE) / 20 AS lc_snow_fraction, a.site % 17 = 0 AS fire
  FROM sums a JOIN sums b ON a.site = b.site AND b.t - a.t BETWEEN 1 AND 12
)
"""


def unit(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CAST({x} AS DOUBLE), 0.0::DOUBLE)))"


def weighted(weights: dict, rain: float | None = None) -> str:
    """The weighted sum as SQL, terms in the same order."""
    return "(0.0::DOUBLE + " + " + ".join(f"({w}::DOUBLE) * {unit(f'{k} / {rain}::DOUBLE' if rain and k.startswith('precip_7day') else k)}" for k, w in weights.items()) + ")"


def features(spark: SparkSession, folder: str) -> DataFrame:
    days = E.trailing_sums(site_days(spark, folder)).drop("day", "n")
    p = E.day_pairs(days, 12)
    share = lambda n, d: F.pmod("site", F.lit(n)).cast("double") / d
    b = F.pmod(F.col("site") * 37 + F.col("t_d1") * 13, F.lit(900)).cast("double")
    ndvi = lambda d: F.pmod(F.col("site") + F.col(f"t_{d}"), F.lit(10)).cast("double") / 10
    dtn = F.least(F.col("dt") / 180.0, F.lit(1.0))
    month = lambda d: F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.col(f"t_{d}").cast("int")))
    lat = F.pmod("site", F.lit(190)) - 95
    amounts = [F.col(f"{c}_{d}").cast("double").alias(f"{c}_{d}") for c in ("precip", "precip_3day", "precip_7day") for d in ("d1", "d2")]
    return p.select(
        "site", "t_d1", "t_d2", "dt", *amounts,
        *(F.col(f"temp_{d}").alias(f"temp_max_{d}") for d in ("d1", "d2")), *(F.col(f"snow_{d}").alias(f"snow_cover_frac_{d}") for d in ("d1", "d2")),
        dtn.alias("dt_normalized"), Q.unit((b - 150) / 650).alias("bperp_normalized"), b.alias("bperp"),
        Q.snow_delta(F.col("snow_d1"), F.col("snow_d2")).alias("delta_snow_cover"), Q.freeze_thaw(F.col("temp_d1"), F.col("temp_d2")).alias("freeze_thaw"),
        ndvi("d1").alias("ndvi_d1"), ndvi("d2").alias("ndvi_d2"), (F.greatest(ndvi("d1"), ndvi("d2")) * dtn).alias("veg_temporal"),
        Q.season_penalty(month("d1"), month("d2"), lat).alias("season_penalty"), Q.annual_repeat(F.col("dt")).cast("int").alias("is_annual_repeat"),
        share(5, 10).alias("lc_forest_fraction"), share(3, 10).alias("lc_urban_fraction"), share(2, 10).alias("lc_bare_fraction"), share(4, 10).alias("lc_crop_fraction"), F.lit(0.1).alias("lc_grass_fraction"), share(2, 5).alias("lc_shrub_fraction"),
        share(7, 10).alias("lc_water_fraction"), share(11, 20).alias("lc_snow_fraction"), (F.pmod("site", F.lit(17)) == 0).alias("fire"),
    )


@query("SELECT site, t, n, round(CAST(precip AS DOUBLE), 2) AS precip, round(CAST(sum(precip) OVER (PARTITION BY site ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS precip_3day, round(CAST(sum(precip) OVER (PARTITION BY site ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS precip_7day, round(snow, 6) AS snow FROM site_days")
def features_trailing_rain(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums and trailing three- and seven-day rain."""
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return E.trailing_sums(site_days(spark, folder)).select("site", "t", "n", two("precip"), two("precip_3day"), two("precip_7day"), F.round("snow", 6).alias("snow"))


@query(WITH + PAIRS + "SELECT site, t FROM sums WHERE coalesce(temp > 0 AND snow > 0.30, false) OR snow >= 0.5 OR coalesce(precip_3day, precip) >= 25")
def features_bad_days(spark: SparkSession, folder: str) -> DataFrame:
    """wet snow, much snow, or much rain."""
    return E.bad_days(E.trailing_sums(site_days(spark, folder))).select("site", "t")


@query("SELECT site, day, hour, n, round(CAST(total AS DOUBLE), 2) AS total, h17 FROM (SELECT CAST(user_id AS BIGINT) AS site, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INT) AS hour, count(*) AS n, sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS total, hour(ts) = 17 AS h17 FROM events GROUP BY 1, 2, 3, 6) WHERE hour = (site * 7) % 24 OR h17")
def features_hour_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly values at each site's overpass hour, or at the default hour 17."""
    e = table(spark, folder, "events")
    hourly = e.groupBy(F.col("user_id").cast("long").alias("site"), F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    site = hourly.select("site").distinct()
    wanted = site.select("site", F.explode(F.array(F.pmod(F.col("site") * 7, F.lit(24)).cast("int"), F.lit(17))).alias("hour")).distinct()
    return hourly.join(wanted, ["site", "hour"]).select("site", "day", "hour", "n", "total", (F.col("hour") == 17).alias("h17"))


@query("""SELECT site, t, "at", value, CASE WHEN "at" IS NULL THEN 'climatology' ELSE 'composite' END AS source FROM (
SELECT a.site, a.t, b."at", b.value, row_number() OVER (PARTITION BY a.site, a.t ORDER BY abs(b."at" - a.t), b."at") AS rn FROM site_days a LEFT JOIN (SELECT site, t AS "at", n AS value FROM site_days WHERE t % 9 = 0 AND site % 4 <> 0) b ON a.site = b.site AND abs(b."at" - a.t) <= 16) WHERE rn = 1""")
def features_nearest_composite(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vegetation composite, else the name of the next tier."""
    d = site_days(spark, folder)
    comp = d.where("t % 9 = 0 AND site % 4 != 0").select("site", F.col("t").alias("at"), F.col("n").alias("value"))
    return E.nearest(d.select("site", "t"), comp, "site", 16).withColumn("source", F.when(F.col("at").isNull(), "climatology").otherwise("composite"))


@query("""SELECT site, t, "at", cloud, value FROM (SELECT a.site, a.t, b."at", b.cloud, b.value, row_number() OVER (PARTITION BY a.site, a.t ORDER BY b.cloud // 20, abs(b."at" - a.t), b."at") AS rn
FROM site_days a JOIN (SELECT site, t AS "at", CAST((t * 31 + site * 17) % 100 AS BIGINT) AS cloud, n AS value FROM site_days) b ON a.site = b.site AND abs(b."at" - a.t) <= 5 WHERE b.cloud <= 60) WHERE rn = 1""")
def features_best_optical(spark: SparkSession, folder: str) -> DataFrame:
    """Within five days and under 60 % cloud, the least cloudy class, then the nearest."""
    d = site_days(spark, folder)
    o = d.select("site", F.col("t").alias("at"), F.pmod(F.col("t") * 31 + F.col("site") * 17, F.lit(100)).alias("cloud"), F.col("n").alias("value"))
    return E.best_in_window(d.select("site", "t"), o, "site", 5, 60, [F.floor(F.col("cloud") / 20), F.abs(F.col("at") - F.col("t")), F.col("at")])


@query("SELECT s.scene, s.path, s.t, f.file FROM scenes s JOIN (SELECT path, t AS v, min(scene) AS file FROM scenes WHERE scene % 3 = 0 GROUP BY path, t) f ON s.path = f.path AND s.t BETWEEN f.v - 1 AND f.v + 1 QUALIFY row_number() OVER (PARTITION BY s.scene ORDER BY f.file) = 1")
def features_orbit_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first orbit file whose validity holds the scene's time."""
    from .adapters import scenes

    s = scenes(spark, folder)
    f = s.where("scene % 3 = 0").groupBy("path", F.col("t").alias("v")).agg(F.min("scene").alias("file")).select("path", "file", (F.col("v") - 1).alias("v0"), (F.col("v") + 1).alias("v1"))
    return E.interval_first(s.select(F.col("scene").alias("id"), "path", "t"), f, "path").select(F.col("id").alias("scene"), "path", "t", "file")


@query()
def features_orbit_at_time(spark: SparkSession, folder: str) -> DataFrame:
    """State vectors interpolated through the eight around each noon."""
    e = table(spark, folder, "events")
    v = e.select(F.col("user_id").cast("long").alias("site"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("at"), "value")
    noon = site_days(spark, folder).select("site", ((F.col("t") - 19723) * 86400 + 43200).cast("double").alias("t"))
    return E.lagrange(noon, v, "site").select("site", "t", "n_used", F.round("value", 3).alias("value"))


@query("SELECT 'geometry' AS section, CAST(site AS VARCHAR) AS key, max(n) AS fetched FROM (SELECT site, 700 - CAST(t - 19723 AS BIGINT) * 20 AS n FROM site_days WHERE t % 3 = 0) GROUP BY site HAVING 1000 - max(n) <= 365")
def features_store(spark: SparkSession, folder: str) -> DataFrame:
    """Stored features still valid: the last fetch within 365 days."""
    d = site_days(spark, folder)
    store = d.where("t % 3 = 0").select(F.lit("geometry").alias("section"), F.col("site").cast("string").alias("key"), F.col("n").alias("value"), (700 - (F.col("t") - 19723) * 20).alias("fetched"))
    wanted = d.select(F.lit("geometry").alias("section"), F.col("site").cast("string").alias("key")).distinct()
    return E.fresh(store, wanted, 1000, {"geometry": 365, "landcover": 365})[0].select("section", "key", "fetched")


@query(WITH + PAIRS + f"SELECT site, t_d1, t_d2, round({unit('1 - ' + weighted(Q.FLAT))}, 9) AS score FROM fv")
def quality_flat(spark: SparkSession, folder: str) -> DataFrame:
    """The flat score of pairs of days."""
    return features(spark, folder).select("site", "t_d1", "t_d2", Q.flat_score(digits=9).alias("score"))


KILLS = """list_filter([CASE WHEN lc_water_fraction > 0.5 THEN 'water_dominant' END, CASE WHEN lc_snow_fraction > 0.4 THEN 'snow_ice_dominant' END, CASE WHEN greatest(coalesce(precip_d1, 0), coalesce(precip_d2, 0)) > 30 THEN 'heavy_rain' END,
CASE WHEN coalesce(temp_max_d1 > 0 AND snow_cover_frac_d1 > 0.3, false) OR coalesce(temp_max_d2 > 0 AND snow_cover_frac_d2 > 0.3, false) THEN 'wet_snow' END, CASE WHEN delta_snow_cover > 0.5 THEN 'fresh_snowfall' END, CASE WHEN greatest(snow_cover_frac_d1, snow_cover_frac_d2) > 0.9 THEN 'heavy_snow_cover' END, CASE WHEN fire THEN 'fire' END], lambda x: x IS NOT NULL)"""


@query(WITH + PAIRS + f"""SELECT site, t_d1, t_d2, array_to_string({KILLS}, ',') AS kills, CASE WHEN len({KILLS}) > 0 THEN 0 ELSE round({unit("CASE WHEN v >= 0.4 AND (ndvi_d1 >= 0.3) <> (ndvi_d2 >= 0.3) THEN least(m, 0.5) ELSE m END")}, 9) END AS score FROM (
SELECT *, (a / tot) * {unit('1 - ' + weighted(Q.URBAN_BARE, 80.0))} + (v / tot) * {unit('1 - ' + weighted(Q.VEGETATION, 80.0))} + (c / tot) * least({unit('1 - ' + weighted(Q.FOREST, 80.0))}, 0.25) AS m FROM (SELECT *, CASE WHEN a + v + c = 0 THEN 1 ELSE a + v + c END AS tot FROM (SELECT *, lc_urban_fraction + lc_bare_fraction AS a, lc_crop_fraction + lc_grass_fraction + lc_shrub_fraction AS v, lc_forest_fraction AS c FROM fv)))""")
def quality_landcover(spark: SparkSession, folder: str) -> DataFrame:
    """Q3: kills, branch scores mixed by land cover, caps."""
    return features(spark, folder).select("site", "t_d1", "t_d2", F.array_join(Q.hard_kills(), ",").alias("kills"), Q.landcover_score(9).alias("score"))


POINTS = "greatest(0, least(100, round_even((1 - (pow({c}, 2) + 0.25 * least(1, greatest(snow_cover_frac_d1, snow_cover_frac_d2, delta_snow_cover)) + 0.75 * {r1} + 0.75 * {r2} + 0.05 * (0.05 * freeze_thaw))) * 100, 0)))".format(c=unit("(0.40 - coh) / 0.30"), r1=unit("precip_3day_d1 / 30.0"), r2=unit("precip_3day_d2 / 30.0"))


@query(WITH + PAIRS + f"SELECT site, t_d1, t_d2, CASE WHEN coalesce(temp_max_d1 > 0 AND snow_cover_frac_d1 > 0.3, false) OR coalesce(temp_max_d2 > 0 AND snow_cover_frac_d2 > 0.3, false) THEN 0 ELSE {POINTS} END AS score100, 'coherence' AS tier FROM (SELECT *, CAST((site * 3 + t_d1 + t_d2 * 5) % 60 AS DOUBLE) / 100 AS coh FROM fv)")
def quality_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Points from the coherence, with the weather's penalties."""
    return coherence_points(features(spark, folder))


def coherence_points(f: DataFrame) -> DataFrame:
    f = f.withColumn("coherence_expected", F.pmod(F.col("site") * 3 + F.col("t_d1") + F.col("t_d2") * 5, F.lit(60)).cast("double") / 100)
    f = f.withColumns({"coherence_source": F.lit("s3"), "coherence_climatology": F.lit(None).cast("double"), "lc_dominant_class": F.lit(10), "ndvi_max": F.greatest("ndvi_d1", "ndvi_d2")})
    return f.select("site", "t_d1", "t_d2", Q.coherence_score().alias("s")).select("site", "t_d1", "t_d2", "s.score100", "s.tier")


def contributed(weights: dict) -> str:
    """Names of the features by falling share of the score, as SQL."""
    shares = ", ".join(f"{{o: -abs(round({w}::DOUBLE * {unit(k)}, 4)), k: '{k}'}}" for k, w in weights.items())
    return f"array_to_string(list_transform(list_sort(list_filter([{shares}], lambda s: -s.o > 0.001)), lambda s: s.k), ',')"


WET = "coalesce(temp_max_d1 > 0 AND snow_cover_frac_d1 > 0.3, false) OR coalesce(temp_max_d2 > 0 AND snow_cover_frac_d2 > 0.3, false)"


@query(WITH + PAIRS + f"""SELECT site, t_d1, t_d2, tier, contributions, round(CASE tier WHEN 'landcover' THEN 100 * CASE WHEN len({KILLS}) > 0 THEN 0 ELSE round({unit("CASE WHEN v >= 0.4 AND (ndvi_d1 >= 0.3) <> (ndvi_d2 >= 0.3) THEN least(m, 0.5) ELSE m END")}, 4) END WHEN 'flat' THEN 100 * flat ELSE CASE WHEN {WET} THEN 0 ELSE {POINTS} END END, 2) AS score100 FROM (
SELECT *, (a / tot) * {unit('1 - ' + weighted(Q.URBAN_BARE, 80.0))} + (v / tot) * {unit('1 - ' + weighted(Q.VEGETATION, 80.0))} + (c / tot) * least({unit('1 - ' + weighted(Q.FOREST, 80.0))}, 0.25) AS m FROM (SELECT *, CASE WHEN a + v + c = 0 THEN 1 ELSE a + v + c END AS tot FROM (
SELECT *, lc_urban_fraction + lc_bare_fraction AS a, lc_crop_fraction + lc_grass_fraction + lc_shrub_fraction AS v, coalesce(lc_forest_fraction, 0) AS c, (['coherence', 'landcover', 'climatology', 'flat'])[CAST(site % 4 + 1 AS INT)] AS tier, CASE site % 4 WHEN 0 THEN 0.3 ELSE 0.2 END::DOUBLE AS coh, round({unit('1 - ' + weighted(Q.FLAT))}, 4) AS flat, {contributed(Q.FLAT)} AS contributions
FROM (SELECT * REPLACE (CASE WHEN site % 4 = 1 THEN lc_forest_fraction END AS lc_forest_fraction, CASE WHEN site % 4 = 1 THEN ndvi_d1 END AS ndvi_d1) FROM fv))))""".replace("CASE site % 4 WHEN 0 THEN 0.3 ELSE 0.2 END::DOUBLE", "CAST(CASE site % 4 WHEN 0 THEN 0.3 ELSE 0.2 END AS DOUBLE)"))
def quality_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Each tier of the cascade, with the flat score's largest contributions."""
    f = features(spark, folder)
    third = F.pmod("site", F.lit(4))
    f = f.withColumns({"coherence_expected": F.when(third == 0, 0.3), "coherence_source": F.when(third == 1, "failed").otherwise("s3"), "coherence_climatology": F.when(third == 2, 0.2), "lc_dominant_class": F.when(third == 1, 10), "ndvi_max": F.lit(None).cast("double")})
    f = f.withColumns({"lc_forest_fraction": F.when(third == 1, F.col("lc_forest_fraction")), "ndvi_d1": F.when(third == 1, F.col("ndvi_d1"))})
    top = F.array_sort(F.map_entries(Q.contributions()), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).otherwise(1))
    return f.select("site", "t_d1", "t_d2", Q.coherence_score().alias("s"), top.alias("c")).select("site", "t_d1", "t_d2", "s.tier", F.round("s.score100", 2).alias("score100"), F.array_join(F.transform("c", lambda x: x["key"]), ",").alias("contributions"))


@query(WITH + PAIRS + f"""SELECT site, t_d1, t_d2, round({unit("1 - (0.30 * d + 0.15 * least(abs(bperp) / 300, 1) + 0.25 * snow + 0.15 * season_penalty + 0.15 * ndvi_d1 * d - CASE WHEN len(list_filter([1, 2, 3, 4], lambda n: abs(dt - n * 365) <= 20)) > 0 THEN 0.3 ELSE 0 END)")}, 9) AS score FROM (
SELECT *, least(CAST(dt AS DOUBLE) / 180, 1.0::DOUBLE) AS d, CASE WHEN coalesce(precip_d1, 0) > 20 THEN CASE WHEN temp_max_d1 > 0 THEN 1.0 ELSE 0.85 END WHEN coalesce(precip_d1, 0) > 5 THEN 0.6 WHEN coalesce(precip_d2, 0) > 1 THEN 0.3 ELSE 0 END AS snow0, snow0::DOUBLE AS snow FROM fv)""")
def quality_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """The older score, rain standing for snow depth."""
    snow = Q.snow_depth_penalty(F.col("precip_d1"), F.col("precip_d2"), F.col("temp_max_d1"))
    return features(spark, folder).select("site", "t_d1", "t_d2", Q.legacy_score(F.col("dt"), F.col("bperp"), snow, F.col("season_penalty"), F.col("ndvi_d1"), 9).alias("score"))


def segments_sql(month: str = "month(b)") -> str:
    """(stack, ref, sec, segment, days, season) of pairs; ``month`` is that of a segment's first day b, in the north."""
    return f"""SELECT stack, ref, sec, i AS segment, CAST(greatest(date_diff('day', b, e), 1) AS INT) AS days, (['winter','winter','spring','spring','spring','summer','summer','summer','fall','fall','fall','winter'])[{month}] AS season FROM (
SELECT stack, ref, sec, unnest(range(len(p) - 1)) AS i, unnest(p[1:len(p) - 1]) AS b, unnest(p[2:len(p)]) AS e FROM (SELECT *, list_concat(list_concat([d1], list_filter(list_transform(range(CAST(date_trunc('month', d1) AS TIMESTAMP), CAST(d2 AS TIMESTAMP), INTERVAL 1 MONTH), lambda x: CAST(x AS DATE)), lambda m: month(m) IN (3, 6, 9, 12) AND m > d1 AND m < d2)), [d2]) AS p FROM (
SELECT a.stack, a.scene AS ref, b.scene AS sec, a.day AS d1, b.day AS d2 FROM collapsed a JOIN collapsed b ON a.stack = b.stack AND b.t - a.t BETWEEN 1 AND 120)))"""


def fit_sql(levels: str, keys: str) -> str:
    """Tables up to fitted (keys, n, g_inf, g0, tau) from levels (keys, lag, coh): the floor of least squared error on the grid."""
    return f""", lv AS (SELECT {keys}, CAST(lag AS DOUBLE) AS x, CAST(coh AS DOUBLE) AS y FROM ({levels})),
base AS (SELECT {keys}, min(y) AS least, count(*) AS n FROM lv GROUP BY {keys} HAVING count(*) >= 3),
grid AS (SELECT *, least * 0.95::DOUBLE * step / {K.STEPS - 1} AS g FROM base, (SELECT unnest(range({K.STEPS})) AS step)),
line AS (SELECT {keys}, step, g, regr_slope(ln(y - g), x) AS s, avg(ln(y - g)) - regr_slope(ln(y - g), x) * avg(x) AS i FROM grid JOIN lv USING ({keys}) GROUP BY {keys}, step, g),
error AS (SELECT {keys}, step, g, s, exp(i) AS a, avg(power(g + exp(i) * exp(s * x) - y, 2)) AS e FROM line JOIN lv USING ({keys}) WHERE s < {K.FALLING} GROUP BY {keys}, step, g, s, i),
best AS (SELECT {keys}, arg_min({{g: g, a: a, s: s}}, {{e: e, step: step}}) AS b FROM error GROUP BY {keys}),
fitted AS (SELECT {keys}, n, coalesce(b.g, 0) AS g_inf, coalesce(least(b.g + b.a, 1), 1) AS g0, coalesce(-1 / b.s, 30) AS tau FROM base LEFT JOIN best USING ({keys}))
"""


CHAINED = """SELECT stack, ref, sec, CASE WHEN count(tau) = count(*) THEN round(sum(days * g_inf) / sum(days) + (sum(days * g0) / sum(days) - sum(days * g_inf) / sum(days)) * exp(-sum(days / tau)), {digits}) END AS coh,
CASE WHEN count(tau) = count(*) THEN round(sum(days * g_inf) / sum(days), {digits}) ELSE 0 END AS floor, count(*) AS n_segments FROM seg LEFT JOIN fitted USING ({on}) GROUP BY stack, ref, sec"""


@query(segments_sql())
def coherence_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of pairs cut at the seasons' first days."""
    return pair_segments(collapsed(spark, folder))


def pair_segments(scenes: DataFrame) -> DataFrame:
    """(stack, ref, sec, segment, days, season) of pairs up to 120 days apart."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int"))
    segments = K.season_segments(day("t_ref"), day("t_sec"), F.lit(45.0))
    return P.all_pairs(scenes, 120).select("stack", "ref", "sec", F.posexplode(segments).alias("i", "s")).select("stack", "ref", "sec", F.col("i").cast("long").alias("segment"), "s.*")


def season_pairs(spark: SparkSession, folder: str, lat: Column) -> DataFrame:
    """Pairs up to 120 days apart that carry the days of each season before both ends."""
    return P.all_pairs(K.season_days(collapsed(spark, folder), lat), 120, K.SEASON_COLUMNS)


@query("SELECT season, lag, round(avg(coh), 6) AS coh, count(*) AS n FROM samples WHERE coh > 0 AND coh < 255 GROUP BY season, lag HAVING count(*) >= 30")
def coherence_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Mean coherence of valid samples per season and lag, with at least 30."""
    s = samples(spark, folder).where("coh > 0 AND coh < 255")
    return s.groupBy("season", "lag").agg(F.round(F.avg("coh"), 6).alias("coh"), F.count("*").alias("n")).where("n >= 30")


def season_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Mean coherence per season and lag, made to fall with the lag."""
    s = samples(spark, folder).where("coh > 0 AND coh < 255")
    return s.groupBy("season", "lag").agg((F.round(F.avg("coh"), 3) / 100).alias("c")).select("season", "lag", F.round(F.col("c") * F.exp(-F.col("lag") / 40), 6).alias("coh"))


@query(WITH + fit_sql("SELECT part, season, lag, avg(coh) / 100 AS coh FROM samples WHERE coh > 0 AND coh < 255 GROUP BY part, season, lag", "part, season") + "SELECT part, season, n AS n_lags, round(g_inf, 6) AS g_inf, round(g0, 6) AS g0, round(1 / tau, 8) AS per_day FROM fitted")
def coherence_decay_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Q8 Q9: floors, starts and decays a day per part and season, from at least three lags."""
    s = samples(spark, folder).where("coh > 0 AND coh < 255")
    levels = s.groupBy("part", "season", "lag").agg((F.avg("coh") / 100).alias("coh"))
    got = K.fit_pixels(levels, ["part", "season"], LEVELS).where("n_lags >= 3")
    return got.select("part", "season", "n_lags", F.round("g_inf", 6).alias("g_inf"), F.round("g0", 6).alias("g0"), F.round(1 / F.col("tau"), 8).alias("per_day"))


@query(WITH + fit_sql("SELECT season, lag, round(round(avg(coh), 3) / 100 * exp(-lag / 40.0::DOUBLE), 6) AS coh FROM samples WHERE coh > 0 AND coh < 255 GROUP BY season, lag", "season") + f", seg AS ({segments_sql()}) " + CHAINED.format(on="season", digits=4))
def coherence_chained(spark: SparkSession, folder: str) -> DataFrame:
    """Q5: coherence of pairs chained over their seasons."""
    return K.chained(season_pairs(spark, folder, F.lit(45.0)), K.fit_pixels(season_levels(spark, folder), ["season"], LEVELS), ["stack", "ref", "sec"])


LEVELS_SQL = ", ".join(f"({band}, '{s}', {lag}, {c})" for band, *values in K.CLIMATOLOGY for s, row in zip(K.SEASON_ORDER, values) for lag, c in zip(K.CLIMATOLOGY_LAGS, row))
PATH = "CAST(split_part(stack, ':', 1) AS BIGINT)"


@query(WITH + fit_sql(f"SELECT * FROM (VALUES {LEVELS_SQL}) v(band, season, lag, coh)", "band, season") + f", seg AS (SELECT *, CAST(least(({PATH} * 7 + 3) % 90 // 10 * 10, 80) AS INT) AS band FROM ({segments_sql(f'CAST((month(b) + CASE WHEN {PATH} % 2 = 1 AND ({PATH} * 7 + 3) % 90 > 0 THEN 5 ELSE 11 END) % 12 + 1 AS INT)')})) " + CHAINED.format(on="band, season", digits=10))
def coherence_climatology(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the climatology of the pair's band of latitude."""
    lat = latitude(F.split("stack", ":")[0].cast("long"))
    pairs = season_pairs(spark, folder, lat).withColumn("band", K.band_of(lat))
    return K.chained(pairs, K.fit_pixels(K.climatology(spark), ["band", "season"], K.CLIMATOLOGY_LAGS), ["stack", "ref", "sec"], ("band",), digits=10)


@query()
def coherence_pixelwise(spark: SparkSession, folder: str) -> DataFrame:
    """Q7: each part is a pixel; mean over the pixels that are valid in all of a pair's seasons."""
    s = samples(spark, folder).where("coh > 0 AND coh < 255")
    maps = K.fit_pixels(s.groupBy("part", "season", "lag").agg((F.avg("coh") / 100).alias("coh")), ["part", "season"], LEVELS).where("n_lags >= 3")
    return K.pixel_chained(season_pairs(spark, folder, F.lit(45.0)), maps, ["stack", "ref", "sec"], ["part"])


@query("SELECT pair, strftime(day, 'A%Y%j') AS code, CAST(CASE WHEN site % 2 = 0 THEN 1 ELSE -1 END * (site % 90) // 10 * 10 AS INT) AS lat, n FROM (SELECT site || '/' || t AS pair, day, site, n FROM site_days)")
def features_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Composite codes and bands of latitude."""
    d = site_days(spark, folder)
    lat = F.when(F.pmod("site", F.lit(2)) == 0, 1).otherwise(-1) * F.pmod("site", F.lit(90))
    return d.select(F.concat_ws("/", "site", "t").alias("pair"), N.composite_code(F.col("day")).alias("code"), (F.when(lat < 0, F.ceil(lat / 10)).otherwise(F.floor(lat / 10)) * 10).cast("int").alias("lat"), "n")
