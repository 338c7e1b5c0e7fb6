"""Registered queries: reanalysis, snow, fires and vegetation over areas; maps at an interval; stored scores and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..functions import geo as G
from ..functions import scores as Q
from ..operators import catalog as C
from ..operators import coherence as K
from ..operators import features as E
from ..operators import graph as GR
from ..operators import pairs as P
from ..operators import pixels as X
from ..operators.cut import place, temporary
from ..sources import tables as S
from .adapters import WITH, collapsed, pixels, samples, scenes, site_days, table
from .features import PAIRS, features
from .network import with_pairs
from .registry import query

# events as hourly cells of 0.1 degrees: user_id gives the cell, value the variables
CELLS = """, cells AS (SELECT date_trunc('hour', ts) AS time, CAST(user_id % 20 AS DOUBLE) / 10 AS lat, CAST(user_id // 20 % 20 AS DOUBLE) / 10 AS lon, round(value, 2) AS value, user_id % 7 AS k FROM events),
area AS (SELECT time, avg(273 + value / 100) AS d2m, avg(280 - value / 50) AS skt, avg(CAST(k AS DOUBLE)) AS u10, avg(value) AS v10, avg(value * 1000) AS ssr, avg(-value * 10) AS str, avg(value / 7) AS smlt, avg(value) AS swvl2, avg(CAST(k AS DOUBLE)) AS lai_hv FROM cells WHERE lat BETWEEN 0.2 AND 1.5 AND lon BETWEEN 0.1 AND 1.7 GROUP BY time)
"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """(time, lat, lon, the variables of a reanalysis): events as hourly cells of 0.1 degrees."""
    e = table(spark, folder, "events").select(F.date_trunc("hour", "ts").alias("time"), F.col("user_id").cast("long").alias("u"), F.round("value", 2).alias("value"))
    x, k = F.col("value"), F.pmod("u", F.lit(7)).cast("double")
    own = {"d2m": 273 + x / 100, "skt": 280 - x / 50, "u10": k, "v10": x, "ssr": x * 1000, "str": -x * 10, "smlt": x / 7, "swvl2": x, "swvl3": x * 2, "lai_hv": k, "lai_lv": k * 2}
    cell = lambda c: F.pmod(c, F.lit(20)).cast("double") / 10
    return e.select("time", cell(F.col("u")).alias("lat"), cell(F.floor(F.col("u") / 20)).alias("lon"), *(c.alias(n) for n, c in own.items()))


AREA = (0.1, 0.2, 1.7, 1.5)


@query(WITH + CELLS + """SELECT CAST(day AS VARCHAR) AS day, hour, round(d2m - 273.15, 2) AS dewpoint, round(skt - 273.15, 2) AS skin_temp, round(CASE WHEN u10 <> 0 AND v10 <> 0 THEN sqrt(u10 * u10 + v10 * v10) END, 3) AS wind_speed, round(swvl2, 4) AS soil, round(ssr + str, 2) AS net_radiation, round(smlt, 4) AS snowmelt FROM (
SELECT w.day, w.hour, a.d2m, a.skt, a.u10, a.v10, a.swvl2, row_number() OVER (PARTITION BY w.day ORDER BY abs(hour(a.time) - w.hour), hour(a.time)) AS rn FROM (SELECT DISTINCT day, CAST(dayofyear(day) % 24 AS INT) AS hour FROM site_days) w LEFT JOIN area a ON CAST(a.time AS DATE) = w.day)
LEFT JOIN (SELECT CAST(time AS DATE) AS d, sum(ssr) AS ssr, sum(str) AS str, sum(smlt) AS smlt FROM area GROUP BY 1) s ON s.d = day WHERE rn = 1""")
def features_reanalysis(spark: SparkSession, folder: str) -> DataFrame:
    """Cells written by month, the months of the wanted days read, means over the area, the overpass hour and 24-hour sums."""
    with temporary(spark) as keep:
        path = place(spark, "reanalysis")
        S.write_reanalysis(grid(spark, folder), path)
        wanted = site_days(spark, folder).select("day").distinct().withColumn("hour", F.pmod(F.dayofyear("day"), F.lit(24)))
        got = E.reanalysis_days(E.area_means(S.read_reanalysis(spark, path, wanted), *AREA), wanted)
        return keep(got.select(F.col("day").cast("string").alias("day"), "hour", "dewpoint", "skin_temp", "wind_speed", F.col("soil_moisture_7_28").alias("soil"), "net_radiation", "snowmelt"), "weather")


@query("SELECT tile, round(CAST(snow AS DOUBLE) / valid, 4) AS snow_cover_frac, round(CAST(ice AS DOUBLE) / n, 4) AS glacier_fraction FROM (SELECT tile, count(*) AS n, count(*) FILTER (v < 200) AS valid, count(*) FILTER (v BETWEEN 40 AND 199) AS snow, count(*) FILTER (v = 254) AS ice FROM (SELECT tile, abs(v) % 256 AS v FROM pixels) GROUP BY tile) WHERE valid > 0")
def features_snow_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of snow among valid pixels and of glacier among all."""
    p = pixels(spark, folder).select("tile", F.pmod(F.abs("v"), F.lit(256)).alias("v"))
    return E.snow_fractions(p, "tile")


FIRES = """, spots AS (SELECT CAST(event_id % 180 AS DOUBLE) / 2 - 45 AS lat, CAST(event_id % 700 AS DOUBLE) / 4 - 80 AS lon, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events WHERE event_type = 'error'),
areas AS (SELECT DISTINCT site, CAST(site % 160 - 80 AS DOUBLE) AS west, CAST(site % 80 - 40 AS DOUBLE) AS south FROM site_days)"""


def fires(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("event_type = 'error'")
    spots = e.select((F.pmod("event_id", F.lit(180)).cast("double") / 2 - 45).alias("lat"), (F.pmod("event_id", F.lit(700)).cast("double") / 4 - 80).alias("lon"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("t"))
    site = site_days(spark, folder).select("site").distinct()
    w, s = F.pmod("site", F.lit(160)).cast("double") - 80, F.pmod("site", F.lit(80)).cast("double") - 40
    return E.fire_days(spots, site.select("site", w.alias("west"), s.alias("south"), (w + 6).alias("east"), (s + 5).alias("north")))


@query(WITH + PAIRS + FIRES + ", burnt AS (SELECT DISTINCT a.site, s.t FROM areas a JOIN spots s ON s.lon BETWEEN a.west AND a.west + 6 AND s.lat BETWEEN a.south AND a.south + 5) SELECT site, t_d1, t_d2, EXISTS (SELECT 1 FROM burnt b WHERE b.site = fv.site AND (b.t BETWEEN t_d1 - 3 AND t_d1 + 3 OR b.t BETWEEN t_d2 - 3 AND t_d2 + 3)) AS fire FROM fv")
def features_fires(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of days with a hotspot in the site's box within three days of either."""
    return E.with_fire(features(spark, folder), fires(spark, folder)).select("site", "t_d1", "t_d2", "fire")


BANDS = ", ".join(f"({lo}, {hi}, {list(months)})" for lo, hi, months in Q.VEGETATION_CLIMATOLOGY)
CASCADE = f""", bands AS (SELECT * FROM (VALUES {BANDS}) v(lo, hi, months)),
lat AS (SELECT *, CAST(site % 190 - 95 AS DOUBLE) AS lat FROM site_days),
cascade AS (SELECT site, t, CASE WHEN site % 5 = 0 AND t % 2 = 0 THEN n / 100.0::DOUBLE WHEN m IS NOT NULL THEN m / 50.0::DOUBLE ELSE c END AS ndvi, CASE WHEN site % 5 = 0 AND t % 2 = 0 THEN 'sentinel2' WHEN m IS NOT NULL THEN 'modis' ELSE 'climatology' END AS source FROM (
  SELECT a.site, a.t, a.n, b.n AS m, coalesce(k.months[month(a.day)], 0.03)::DOUBLE AS c, row_number() OVER (PARTITION BY a.site, a.t ORDER BY abs(b.t - a.t), b.t) AS rn
  FROM lat a LEFT JOIN (SELECT site, t, n FROM site_days WHERE t % 9 = 0 AND site % 4 <> 0) b ON a.site = b.site AND abs(b.t - a.t) <= 16 LEFT JOIN bands k ON a.lat >= k.lo AND a.lat < k.hi) WHERE rn = 1)
"""


def cascade(spark: SparkSession, folder: str) -> DataFrame:
    d = site_days(spark, folder)
    optical = d.where("site % 5 = 0 AND t % 2 = 0").select("site", "t", (F.col("n") / 100).alias("value"))
    composites = d.where("t % 9 = 0 AND site % 4 != 0").select("site", F.col("t").alias("at"), (F.col("n") / 50).alias("value"))
    lat = F.pmod("site", F.lit(190)).cast("double") - 95
    return E.vegetation(d, optical, composites, Q.vegetation_climatology(lat, F.month("day")))


@query(WITH + CASCADE + "SELECT site, t, round(ndvi, 6) AS ndvi, source FROM cascade")
def features_vegetation(spark: SparkSession, folder: str) -> DataFrame:
    """The optical value of a day, else the nearest composite, else climatology by band of latitude and month."""
    return cascade(spark, folder).withColumn("ndvi", F.round("ndvi", 6))


@query(WITH + CASCADE + "SELECT site, CASE WHEN len(s) = 1 THEN s[1] WHEN list_contains(s, 'sentinel2') THEN 'sentinel2' WHEN list_contains(s, 'modis') THEN 'mixed' ELSE 'climatology' END AS ndvi_source, cached FROM (SELECT site, list(DISTINCT source) AS s, NOT bool_or(source = 'modis' AND t % 3 = 0) AS cached FROM cascade GROUP BY site)")
def features_dominant_source(spark: SparkSession, folder: str) -> DataFrame:
    """The source that stands for all of a site's days, and whether nothing was fetched."""
    c = cascade(spark, folder).withColumn("fetched", (F.col("source") == "modis") & (F.col("t") % 3 == 0))
    return E.dominant_source(c, "site")


@query("SELECT site, CAST(day AS VARCHAR) AS day, CAST(n AS DOUBLE) AS temp FROM site_days WHERE day IS NOT NULL")
def source_weather_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly arrays of a payload, read at each site's hour or at the default."""
    d = site_days(spark, folder)
    hour = F.when(F.pmod("site", F.lit(2)) == 0, F.pmod("site", F.lit(24)).cast("int"))
    stamp = lambda h: F.concat(F.col("day").cast("string"), F.lit("T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    each = d.select("site", F.inline(F.array(F.struct(stamp(F.coalesce(hour, F.lit(17))).alias("time"), F.col("n").cast("double").alias("temp")), F.struct(stamp(F.pmod(F.coalesce(hour, F.lit(17)) + 1, F.lit(24))).alias("time"), F.lit(-99.0).alias("temp")))))
    rows = each.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("time", "temp"))).alias("r"))
    take = lambda k: F.transform("r", lambda x: x[k])
    payload = rows.select("site", hour.alias("hour"), F.to_json(F.struct(F.struct(take("time").alias("time"), take("temp").alias("temperature_2m")).alias("hourly"))).alias("payload"))
    return S.weather_hour(payload).select("site", F.col("day").cast("string").alias("day"), "temp")


@query(WITH + PAIRS + "SELECT site, t_d1, t_d2, coalesce(CAST((coalesce(CASE WHEN site % 3 <> 0 THEN temp_max_d1 - 1 END, temp_max_d1) < 0) <> (coalesce(CASE WHEN site % 2 <> 0 THEN temp_max_d2 - 1 END, temp_max_d2) < 0) AS INT), 0) AS freeze_thaw FROM fv")
def features_freeze_thaw(spark: SparkSession, folder: str) -> DataFrame:
    """The overpass temperature where there is one, else the day's highest."""
    at = lambda d, n: F.when(F.pmod("site", F.lit(n)) != 0, F.col(f"temp_max_{d}") - 1)
    return features(spark, folder).select("site", "t_d1", "t_d2", Q.freeze_thaw(at("d1", 3), at("d2", 2), F.col("temp_max_d1"), F.col("temp_max_d2")).alias("freeze_thaw"))


@query(WITH + PAIRS + "SELECT site, t_d1, t_d2, round(greatest(0, least(1, 1 - 0.5 * dt_normalized - 0.5 * bperp_normalized)), 6) AS score FROM fv ORDER BY score DESC, site, t_d1, t_d2")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """The score table, best first; here with two weights given by the user."""
    score = F.round(Q.unit(1 - Q.weighted({"dt_normalized": 0.5, "bperp_normalized": 0.5})), 6)
    return features(spark, folder).select("site", "t_d1", "t_d2", score.alias("score")).orderBy(F.desc("score"), "site", "t_d1", "t_d2")


# --- maps ---


MAPS = ", maps AS (SELECT season, CASE part % 2 WHEN 0 THEN 'VV' ELSE 'VH' END AS pol, part, line, coh / 400.0::DOUBLE AS g_inf, coh / 100.0::DOUBLE AS g0, CAST(lag AS DOUBLE) AS tau, coh > 0 AND coh < 255 AS valid FROM samples)"


def maps(spark: SparkSession, folder: str) -> DataFrame:
    """Samples seen as maps of the decay's parameters; samples without coherence are not valid."""
    coh = F.col("coh")
    return samples(spark, folder).select("season", F.when(F.pmod("part", F.lit(2)) == 0, "VV").otherwise("VH").alias("pol"), (coh / 400).alias("g_inf"), (coh / 100).alias("g0"), F.col("lag").cast("double").alias("tau"), ((coh > 0) & (coh < 255)).alias("valid"))


@query(WITH + MAPS + "SELECT season, pol, count(*) FILTER (valid) AS n_valid, count(*) AS n, " + ", ".join(f"round({f}({c}) FILTER (valid), 6) AS {c}_{n}" for c in ("g_inf", "g0", "tau") for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + " FROM maps GROUP BY season, pol")
def coherence_map_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Valid pixels, and mean, least and most of each parameter, per season and polarization."""
    got = K.map_statistics(maps(spark, folder))
    return got.select("season", "pol", "n_valid", "n", *(F.round(c, 6).alias(c) for c in got.columns[4:]))


@query(WITH + MAPS + "SELECT season, round(avg(g_inf + (g0 - g_inf) * exp(-24.0::DOUBLE / tau)), 6) AS coh, round(avg(g_inf), 6) AS floor, count(*) AS n FROM maps WHERE valid GROUP BY season")
def coherence_maps_at_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Q10: mean coherence and floor of each season's map at 24 days."""
    got = K.evaluate(maps(spark, folder).where("valid"), 24)
    return got.select("season", F.round("coh", 6).alias("coh"), F.round("floor", 6).alias("floor"), "n")


@query("SELECT tile AS layer, row // 4 AS row, col // 4 AS col, v FROM pixels WHERE row % 4 = 1 AND col % 4 = 1")
def pixel_resampled_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes are taken from the pixel nearest to a cell's centre; four are as near, the first of them counts."""
    return X.resampled(pixels(spark, folder).drop("layer").withColumnRenamed("tile", "layer"), 4, 4, categorical=True).drop("n")


# --- stored documents ---


@query(with_pairs("SELECT stack, CAST(ref AS VARCHAR) AS ref, CAST(sec AS VARCHAR) AS sec FROM usable WHERE CAST(split_part(stack, ':', 1) AS BIGINT) % 3 <> 0 OR dt_days <= 24 OR NOT listed").replace("FROM usable WHERE", "FROM (SELECT *, bool_or(dt_days <= 24) OVER (PARTITION BY stack) AS listed FROM usable) WHERE"))
def source_pair_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an explicit list where there is one, else of the stack's document, else of its older file."""
    p = P.primary_pairs(collapsed(spark, folder)).withColumn("k", F.pmod(F.split("stack", ":")[0].cast("long"), F.lit(3)))
    texts = S.stack_documents(p)
    listed = p.where("k = 0 AND dt_days <= 24").groupBy("stack").agg(F.to_json(F.collect_list(F.array(F.col("ref").cast("string"), F.col("sec").cast("string")))).alias("text"))
    third = F.pmod(F.split("stack", ":")[0].cast("long"), F.lit(3))
    legacy = texts.where(third == 2).select("stack", F.get_json_object("document", "$.pairs").alias("text"))
    return S.pairs_of_stacks(texts.where(third != 2), legacy, explicit=listed)


@query(with_pairs("SELECT stack, CAST(n_scenes AS BIGINT) AS n_scenes, CAST(n_pairs AS BIGINT) AS n_pairs, path % 4 = 0 OR path % 5 = 0 AS rebuild FROM (SELECT stack, count(*) AS n_scenes, min(path) AS path FROM collapsed GROUP BY stack) JOIN (SELECT stack, count(*) AS n_pairs FROM usable GROUP BY stack) USING (stack) WHERE path % 4 <> 0"))
def sink_score_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Scores stored with version, counts and scene names; read back, and rebuilt only where scenes are new."""
    s = collapsed(spark, folder)
    p = P.primary_pairs(s).select("stack", "ref", "sec", F.col("bperp").alias("score"))
    path = F.split("stack", ":")[0].cast("long")
    # of every fourth path the document has an older version, of every fifth there is a scene more by now
    docs = S.score_documents(p.where(path % 4 != 0), s).unionByName(S.score_documents(p.where(path % 4 == 0), s, version=1))
    stored = S.stored_scores(docs)
    more = s.select("stack", "scene").unionAll(s.where(path % 5 == 0).select("stack", -F.col("scene") - 1).distinct())
    return stored.select("stack", "n_scenes", "n_pairs").join(S.to_rebuild(stored, more), "stack")


@query(with_pairs("SELECT stack, ref, sec, CASE WHEN sec % 2 = 0 THEN 1 ELSE 0 END AS source, round(CASE WHEN sec % 2 = 0 THEN -bperp ELSE bperp END, 5) + 0.0 AS b FROM usable WHERE sec % 2 = 0 OR ref % 3 = 0"))
def network_layered_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Of two layers the later one wins."""
    p = P.primary_pairs(collapsed(spark, folder)).select("stack", "ref", "sec", F.col("bperp").alias("b"))
    got = P.layered([p.where("ref % 3 = 0"), p.where("sec % 2 = 0").withColumn("b", -F.col("b"))], ["stack", "ref", "sec"])
    return got.withColumn("b", F.round("b", 5) + 0.0)


@query("SELECT path, scene, CASE WHEN scene % 4 = 0 THEN 'annotation' WHEN scene % 3 = 0 THEN 'file' WHEN scene % 2 = 0 THEN 'download' END AS orbit_source, CASE WHEN scene % 4 = 0 THEN t WHEN scene % 3 = 0 THEN t * 10 WHEN scene % 2 = 0 THEN t * 100 END AS value FROM scenes")
def network_orbit_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A scene's orbit from its annotation, else from an orbit file that is there, else from a download."""
    s = scenes(spark, folder).select("path", "scene", "t")
    tier = lambda n, name, k: s.where(F.col("scene") % n == 0).select("scene", F.lit(name).alias("orbit_source"), (F.col("t") * k).alias("value"))
    best = P.by_priority([tier(4, "annotation", 1), tier(3, "file", 10), tier(2, "download", 100)], ["scene"])
    return s.select("path", "scene").join(best.drop("source"), "scene", "left")


@query(with_pairs("SELECT path, pair FROM (SELECT split_part(stack, ':', 1) AS path, t_ref // 730 || '_' || dt_days // 60 AS pair, count(DISTINCT stack) AS h FROM usable GROUP BY 1, 2) JOIN (SELECT split_part(stack, ':', 1) AS path, count(DISTINCT stack) AS n FROM usable GROUP BY 1) USING (path) WHERE h >= n"))
def network_pairs_in_common(spark: SparkSession, folder: str) -> DataFrame:
    """Pair ids (two years and an interval in sixties of days) that every swath of a track has; here a track's frames are its swaths."""
    p = P.primary_pairs(collapsed(spark, folder)).select(F.split("stack", ":")[0].alias("path"), "stack", F.concat_ws("_", F.floor(F.col("t_ref") / 730), F.floor(F.col("dt_days") / 60)).alias("pair"))
    return C.in_common(p, "path", "stack", "pair")


@query(with_pairs("SELECT path, stack, pair FROM (SELECT DISTINCT split_part(stack, ':', 1) AS path, t_ref // 90 || '_' || dt_days AS pair FROM usable) JOIN (SELECT DISTINCT split_part(stack, ':', 1) AS path, stack FROM usable) USING (path) WHERE (stack, pair) NOT IN (SELECT (stack, t_ref // 90 || '_' || dt_days) FROM usable)"))
def network_pairs_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Per swath the pair ids that another swath of its track has and it lacks."""
    p = P.primary_pairs(collapsed(spark, folder)).select(F.split("stack", ":")[0].alias("path"), "stack", F.concat_ws("_", F.floor(F.col("t_ref") / 90), "dt_days").alias("pair"))
    return C.missing_items(p, "path", "stack", "pair")


# the positions and speeds are made of each scene's numbers; its own SQL does the vector algebra out in full
VECTORS = """, vec AS (SELECT stack, scene, t, CAST(path AS DOUBLE) * 2 - 20 AS lat, CAST(path AS DOUBLE) AS lon, 7000000.0::DOUBLE + bperp_m * 3 AS rx, 1000.0::DOUBLE + bperp_m AS ry, 500.0::DOUBLE - bperp_m AS rz, 7500.0::DOUBLE AS vx, 100.0::DOUBLE AS vy, 300.0::DOUBLE + path AS vz, scene % 6 <> 0 OR bperp_m < -200 AS has FROM collapsed),
anchor AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t, scene) = 1),
ground AS (SELECT *, (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * power(sin(radians(lat)), 2))) AS n FROM anchor),
beam AS (SELECT *, rx - n * cos(radians(lat)) * cos(radians(lon)) AS bx, ry - n * cos(radians(lat)) * sin(radians(lon)) AS "by", rz - n * (1 - 0.0066943799901413165::DOUBLE) * sin(radians(lat)) AS bz FROM ground),
up AS (SELECT *, vy * bz - vz * "by" AS ux, vz * bx - vx * bz AS uy, vx * "by" - vy * bx AS uz FROM beam),
own AS (SELECT v.stack, v.scene, v.has, u.has AS anchored, v.scene = u.scene AS is_anchor, (u.ux * (v.rx - u.rx) + u.uy * (v.ry - u.ry) + u.uz * (v.rz - u.rz)) / sqrt(u.ux * u.ux + u.uy * u.uy + u.uz * u.uz) AS b FROM vec v JOIN up u USING (stack))
"""


@query(WITH + VECTORS + "SELECT stack, scene, round(CASE WHEN NOT anchored THEN NULL WHEN is_anchor THEN 0 WHEN has AND abs(b) <= 5000 THEN b END, 4) + 0.0 AS bperp FROM own")
def network_anchor_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Baselines against each stack's first scene, from positions: the distance along the beam's upward direction."""
    s = collapsed(spark, folder)
    path, b = F.split("stack", ":")[0].cast("double"), F.col("bperp_m")
    has = (F.col("scene") % 6 != 0) | (b < -200)
    xyz = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    r = F.when(has, xyz(7000000.0 + b * 3, 1000.0 + b, 500.0 - b))
    v = s.select("stack", "scene", "t", (path * 2 - 20).alias("lat"), path.alias("lon"), r.alias("r"), xyz(F.lit(7500.0), F.lit(100.0), 300.0 + path).alias("v"))
    return P.anchor_baselines(v).withColumn("bperp", F.round("bperp", 4) + 0.0)


@query()
def network_burst_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts, whose node is the date: the network of dates is chosen, each burst that has both gives a pair."""
    s = scenes(spark, folder).withColumn("stack", F.col("path").cast("string"))
    b = s.groupBy("stack", F.col("frame").alias("burst"), "t").agg(F.min("scene").alias("scene"), F.min_by("bperp_m", "scene").alias("bperp_m"))
    return GR.burst_pairs(b).select("stack", "burst", "ref", "sec", "t_ref", "t_sec", "dt_days", F.round("bperp", 5).alias("bperp"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN 2.33 ELSE 299792458.0::DOUBLE / (2 * (64000000 + c_custkey)) END / sin(radians(39.0::DOUBLE)) * (c_custkey % 4 + 1), 6) AS range_m, round(CASE WHEN c_custkey % 5 = 0 THEN 13.9 ELSE 7100.0::DOUBLE / 1717 END * (c_custkey % 2 + 1), 6) AS azimuth_m FROM customer")
def scalar_ground_posting(spark: SparkSession, folder: str) -> DataFrame:
    """Metres on the ground of multilooked pixels, from a header's rates or the nominal ones."""
    k = F.col("c_custkey")
    sampling = F.when(k % 3 != 0, (64000000 + k).cast("double"))
    p = G.ground_posting(sampling, F.when(k % 5 != 0, 1717.0), F.lit(7100.0), k % 4 + 1, k % 2 + 1)
    return table(spark, folder, "customer").select("c_custkey", F.round(p["range"], 6).alias("range_m"), F.round(p["azimuth"], 6).alias("azimuth_m"))


@query("SELECT tile, CASE WHEN hi > lo THEN lo END AS first, CASE WHEN hi > lo THEN hi END AS last FROM (SELECT tile, greatest(0, CAST(trunc(r0 - m) AS BIGINT)) AS lo, least(400, CAST(trunc(r1 + m) AS BIGINT)) AS hi FROM (SELECT *, CASE WHEN r1 > r0 THEN (r1 - r0) * 0.05 ELSE 100.0 END AS m FROM (SELECT tile, CAST(min(row) * 9 AS DOUBLE) AS r0, CAST(CASE WHEN tile % 5 = 0 THEN min(row) ELSE max(row) END * 9 AS DOUBLE) AS r1 FROM pixels GROUP BY tile)))")
def pixel_margin_box(spark: SparkSession, folder: str) -> DataFrame:
    """A range with a margin of 5 %, 100 around a point, within the frame; null outside of it."""
    e = X.extents(pixels(spark, folder), "tile")
    r0, r1 = (F.col("row0") * 9).cast("double"), (F.when(F.col("tile") % 5 == 0, F.col("row0")).otherwise(F.col("row1")) * 9).cast("double")
    lo, hi = G.margin_box(r0, r1, F.lit(400))
    return e.select("tile", lo.alias("first"), hi.alias("last"))


@query("SELECT site, t, CASE WHEN most <= 1.5 THEN greatest(0, least(100, round_even(s * 100, 0))) ELSE s END AS score FROM (SELECT *, max(s) OVER (PARTITION BY site) AS most FROM (SELECT site, t, CAST((site + t) % 101 AS DOUBLE) / CASE WHEN site % 2 = 0 THEN 100 ELSE 1 END AS s FROM site_days))")
def quality_rescaled(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of scores whose largest is at most 1.5 become points of 100."""
    s = F.pmod(F.col("site") + F.col("t"), F.lit(101)).cast("double") / F.when(F.col("site") % 2 == 0, 100).otherwise(1)
    d = site_days(spark, folder).select("site", "t", s.alias("s"))
    return d.select("site", "t", Q.rescaled(F.col("s"), F.max("s").over(Window.partitionBy("site"))).alias("score"))


FOUND = "list_has_any(string_split(polarization, '+'), ['1', 'URGENT', '2', 'HIGH']) AND month(day) IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND day BETWEEN DATE '1993-02-01' AND DATE '1998-03-31' AND orbit % 5 <> 0 AND scene % 1000 < 900 AND scene % 11 < 9"


@query(f"""{WITH}, s AS (SELECT * REPLACE (replace(polarization, '-', '+') AS polarization), CAST(scene % 16 AS DOUBLE) AS west, CAST(scene % 14 AS DOUBLE) AS south FROM scenes),
firsts AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t, scene) = 1),
kept AS (SELECT s.*, greatest(0, least(14.0, west + 8) - greatest(10.0, west)) * greatest(0, least(13.0, south + 6) - greatest(10.0, south)) / 12.0 AS cov FROM s WHERE stack IN (SELECT stack FROM firsts WHERE direction = 'DESCENDING' AND level <> 'P') AND {FOUND}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY t DESC, scene DESC) AS n FROM kept WHERE cov >= 0.25) SELECT stack, scene, t FROM numbered WHERE n <= 12 AND stack IN (SELECT stack FROM numbered WHERE n = 4)""")
def catalog_filter_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The whole filter in its order, first items, scene values, coverage, limit, count."""
    s = scenes(spark, folder)
    w, b = F.pmod("scene", F.lit(16)).cast("double"), F.pmod("scene", F.lit(14)).cast("double")
    s = s.withColumns({"polarization": F.translate("polarization", "-", "+"), "look": F.lit("right"), "beam": F.when(F.col("level") == "P", "EW").otherwise("IW"), "asf_frame": F.pmod("scene", F.lit(1000)), "absolute_orbit": F.pmod("scene", F.lit(11)), "west": w, "south": b, "east": w + 8, "north": b + 6})
    return C.filter_stacks(
        s, start="1993-02-01", end="1998-03-31", direction="descending", look="RIGHT", beam="iw", months=[1, 2, 3, 4, 5, 6, 7, 8, 9], polarizations=["1", "URGENT", "2", "HIGH"],
        orbits=[x for x in range(175) if x % 5], asf_frames=range(900), absolute_orbits=range(9), min_coverage=0.25, aoi=(10, 10, 14, 13), latest=12, min_count=4,
    ).select("stack", "scene", "t")


@query("SELECT scene, CASE WHEN scene % 7 = 0 THEN 'b' || orbit WHEN scene % 7 = 1 THEN 'f' || orbit WHEN scene % 4 = 0 THEN 'f' || orbit WHEN scene % 4 = 1 THEN 'n' || orbit WHEN scene % 4 = 2 THEN 'b' || orbit WHEN scene % 5 = 0 THEN 'n' || orbit ELSE 'f' || orbit END AS frame FROM scenes")
def catalog_group_keys(spark: SparkSession, folder: str) -> DataFrame:
    """What groups scenes beside the path, by the search, the dataset, then the platform."""
    k = F.col("scene")
    orbit = F.col("orbit").cast("string")
    props = F.create_map(F.lit("pathNumber"), F.col("path").cast("string"), *(x for n, h in (("frameNumber", "f"), ("frameID", "n"), ("burstID", "b")) for x in (F.lit(n), F.concat(F.lit(h), orbit))))
    dataset = F.when(k % 4 == 0, "sentinel-1").when(k % 4 == 1, "NISAR").when(k % 4 == 2, "burst").otherwise("other")
    platform = F.when(k % 5 == 0, "nisar-a").otherwise("Sentinel-1A")
    return scenes(spark, folder).select("scene", N.group_key(props, N.frame_key(dataset, platform, k % 7 == 0, k % 7 == 1))["frame"].alias("frame"))


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT c_nationkey, unnest(['a', 'b', 'c']) FROM customer WHERE c_custkey % 2 = 0) GROUP BY c_nationkey")
def source_required_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of products classified by name; each product must have its three layers."""
    c = table(spark, folder, "customer").where("c_custkey % 2 = 0")
    ends = F.array(*map(F.lit, ("_unw_phase.tif", "_corr.tif", "_dem.tif", "_browse.png")))
    files = c.select("c_nationkey", "c_custkey", F.explode(ends).alias("end")).select("c_nationkey", F.col("c_custkey").alias("product"), S.archive_kind(F.concat_ws("_", F.lit("S1"), "c_custkey", "end")).alias("kind"))
    whole = S.required_layers(files.select("product", "kind"))
    return whole.join(c.select(F.col("c_custkey").alias("product"), "c_nationkey"), "product").groupBy("c_nationkey").agg(F.sum(F.col("n_unwrapped") + F.col("n_coherence") + F.col("n_dem")).alias("n"))
