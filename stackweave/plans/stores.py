"""Registered queries: networks edited in full; stores, XML documents, map stores and exports written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import decay
from ..operators import coherence as K
from ..operators import editing as ED
from ..operators import pairs as P
from ..operators.cut import place, temporary
from ..sources import store as ST
from ..sources import tables as S
from ..sources import xml as XM
from .adapters import LEVELS, WITH, collapsed, pixels, samples, site_days, table
from .features import fit_sql
from .network import with_pairs
from .registry import query

# --- network editing ---


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Usable pairs with a coherence and the share of their pixels that are coherent, some without."""
    p = P.primary_pairs(collapsed(spark, folder))
    k = F.col("ref") * 7 + F.col("sec") * 3
    return p.withColumns({"coh": F.when(k % 19 != 0, (k % 83) / 100.0), "ratio": F.when(k % 23 != 0, (k % 71) / 70.0)})


EDITED = """, scored AS (SELECT *, CASE WHEN (ref * 7 + sec * 3) % 19 <> 0 THEN (ref * 7 + sec * 3) % 83 / 100.0::DOUBLE END AS coh, CASE WHEN (ref * 7 + sec * 3) % 23 <> 0 THEN (ref * 7 + sec * 3) % 71 / 70.0::DOUBLE END AS ratio FROM usable),
placed AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY t_ref, t_sec, ref, sec) - 1 AS i FROM scored),
dates AS (SELECT stack, t, row_number() OVER (PARTITION BY stack ORDER BY t) AS n FROM (SELECT stack, t_ref AS t FROM usable UNION SELECT stack, t_sec FROM usable))
"""


def listed(p: DataFrame, share: int) -> DataFrame:
    """Some pairs, turned round."""
    return p.where((F.col("ref") + F.col("sec")) % share == 0).select("stack", F.col("sec").alias("ref"), F.col("ref").alias("sec"))


@query(with_pairs(EDITED + """SELECT p.stack, ref, sec FROM placed p JOIN dates a ON a.stack = p.stack AND a.t = t_ref JOIN dates b ON b.stack = p.stack AND b.t = t_sec
WHERE dt_days <= 72 AND bperp <= 120 AND abs(b.n - a.n) <= 6 AND least(t_ref, t_sec) >= 8200 AND greatest(t_ref, t_sec) <= 10200 AND t_ref NOT IN (8300, 8301, 8302) AND t_sec NOT IN (8300, 8301, 8302)
AND (ref + sec) % 5 <> 0 AND i % 9 <> 4 AND (ref + sec) % 2 = 0 AND coh >= 0.2 AND ratio >= 0.3"""))
def network_edited_fully(spark: SparkSession, folder: str) -> DataFrame:
    """Every option at once: intervals, baselines, connections, dates, pairs, positions, a reference network, coherence, area ratio."""
    p = scored(spark, folder)
    places = ED.positions(p).where("index % 9 = 4").select("stack", "index")
    got = ED.edited(p, temp_max=72, perp_max=120, conn_max=6, start=8200, end=10200, exclude_dates=[8300, 8301, 8302], exclude_pairs=listed(p, 5), exclude_index=places, reference=listed(p, 2), min_coherence=0.2, min_ratio=0.3)
    return got.select("stack", "ref", "sec")


@query()
def network_edited_keeping_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs under a coherence dropped, but for those of the spanning tree."""
    got = ED.edited(scored(spark, folder), temp_max=72, min_coherence=0.5, min_ratio=0.3, keep_tree=True)
    return got.select("stack", "ref", "sec", F.round("coh", 4).alias("coh"))


@query("SELECT stack, ref, sec, round(avg(CASE WHEN coh >= 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM (SELECT season AS stack, lag AS ref, part % 50 AS sec, coh FROM samples WHERE coh > 0) GROUP BY 1, 2, 3")
def network_area_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """the share of each pair's valid pixels that reach a coherence."""
    s = samples(spark, folder).select(F.col("season").alias("stack"), F.col("lag").alias("ref"), (F.col("part") % 50).alias("sec"), F.when(F.col("coh") > 0, F.col("coh")).alias("coh"))
    return ED.area_ratio(s, 30).withColumn("ratio", F.round("ratio", 6))


# --- a store of features ---


@query("SELECT section, key, CASE WHEN NOT (section = 'geometry' AND t < 19723 + 5) THEN value END AS value FROM (SELECT *, CASE WHEN section = 'geometry' THEN 'g' WHEN t % 2 = 0 THEN 'new' ELSE 'w' END || n AS value FROM (SELECT CASE WHEN site % 3 = 0 THEN 'geometry' ELSE 'weather' END AS section, site || ':' || t AS key, t, n FROM site_days))")
def features_store_written(spark: SparkSession, folder: str) -> DataFrame:
    """Two writes, the second over keys of the first, then a read in which old rows of an expiring section are missing."""
    d = site_days(spark, folder).select(F.when(F.col("site") % 3 == 0, "geometry").otherwise("weather").alias("section"), F.concat_ws(":", "site", "t").alias("key"), "t", "n")
    mark = F.when(F.col("section") == "geometry", "g").otherwise("w")
    with temporary(spark) as keep:
        path = place(spark, "store")
        ST.put(d.select("section", "key", F.concat(mark, "n").alias("value"), F.col("t").cast("int").alias("fetched")), path, 0)
        ST.put(d.where("section = 'weather' AND t % 2 = 0").select("section", "key", F.concat(F.lit("new"), "n").alias("value")), path, 20200)
        return keep(ST.get(spark, path, d, 19723 + 5 + 365), "stored")


@query("SELECT 'weather' AS section, printf('%.3f:%.3f:%s', CAST(site % 90 AS DOUBLE), CAST(site % 170 AS DOUBLE) / 7, CAST(day AS VARCHAR)) AS key, count(*) AS n FROM site_days WHERE precip IS NOT NULL GROUP BY 2")
def features_store_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """A store seeded from what another step fetched, missing values left out; keys of place and day."""
    d = site_days(spark, folder).select(F.lit("weather").alias("section"), F.pmod("site", F.lit(90)).alias("lat"), (F.pmod("site", F.lit(170)) / 7).alias("lon"), F.col("day").cast("string").alias("day"), F.col("precip").cast("string").alias("value"))
    with temporary(spark) as keep:
        path = place(spark, "store")
        ST.seed(d, path, 20000)
        seen = d.where("value IS NOT NULL").select("section", F.format_string("%.3f:%.3f:%s", F.col("lat").cast("double"), F.col("lon").cast("double"), "day").alias("key")).groupBy("section", "key").agg(F.count("*").alias("n"))
        return keep(ST.rows(spark, path).join(seen, ["section", "key"]).select("section", "key", "n"), "seeded")


# --- XML ---

VECTORS = "SELECT user_id AS site, epoch(date_trunc('second', ts)) AS t, round(value, 2) AS x, round(value, 2) * 2 AS y, CAST(event_id AS DOUBLE) AS z, round(value, 2) / 4 AS vx, CAST(user_id AS DOUBLE) AS vy, -1.5::DOUBLE AS vz FROM events"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(site, v array<struct<utc, x, y, z, vx, vy, vz>>): events as state vectors, in order of time."""
    e = table(spark, folder, "events").withColumn("value", F.round("value", 2))
    v = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").substr(1, 19).alias("utc"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.col("event_id").cast("double").alias("z"), (F.col("value") / 4).alias("vx"), F.col("user_id").cast("double").alias("vy"), F.lit(-1.5).alias("vz"))
    return e.groupBy(F.col("user_id").alias("site")).agg(F.array_sort(F.collect_list(v)).alias("v"))


@query(VECTORS)
def source_orbit_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orbit documents written from state vectors and read back."""
    documents = vectors(spark, folder).select("site", XM.orbit_document(F.col("v")).alias("document"))
    return XM.vectors_of_orbits(documents)


@query(f"SELECT site, count(*) AS n_vectors, round(sum(x), 2) AS x, round(avg(vy), 6) AS vy, min(t) AS first, (min(t) + max(t)) / 2 AS centre_time, round(avg(x / 10), 6) AS lat, round(avg(z % 180), 6) AS lon FROM ({VECTORS}) GROUP BY site")
def source_annotation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation documents: orbit vectors, the scene's centre time, the mean of the geolocation grid."""
    v = vectors(spark, folder)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    three = lambda x, p: F.concat(*(tag(k, x[p + k]) for k in "xyz"))
    orbit = F.array_join(F.transform("v", lambda x: F.concat(F.lit("<orbit>"), tag("time", x["utc"]), F.lit("<position>"), three(x, ""), F.lit("</position><velocity>"), three(x, "v"), F.lit("</velocity></orbit>"))), "")
    points = F.array_join(F.transform("v", lambda x: F.concat(F.lit("<geolocationGridPoint>"), tag("latitude", x["x"] / 10), tag("longitude", x["z"] % 180), F.lit("</geolocationGridPoint>"))), "")
    header = F.concat(F.lit("<adsHeader>"), tag("startTime", F.col("v")[0]["utc"]), tag("stopTime", F.element_at("v", -1)["utc"]), F.lit("</adsHeader>"))
    text = F.concat(F.lit("<product>"), header, F.lit("<generalAnnotation><orbitList>"), orbit, F.lit("</orbitList></generalAnnotation><geolocationGrid><geolocationGridPointList>"), points, F.lit("</geolocationGridPointList></geolocationGrid></product>"))
    got = XM.parts_of_annotations(v.select("site", text.alias("document")))
    total = lambda k: F.aggregate("orbit", F.lit(0.0), lambda a, x: a + x[k])
    n = F.size("orbit")
    return got.select("site", n.cast("long").alias("n_vectors"), F.round(total("x"), 2).alias("x"), F.round(total("vy") / n, 6).alias("vy"), F.array_min(F.transform("orbit", lambda x: x["t"])).alias("first"), "centre_time", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT s_suppkey AS scene, x AS west, y AS south, x + 2.5 AS east, y + 1.25 AS north, CAST(4 AS BIGINT) AS n_points FROM (SELECT s_suppkey, (s_suppkey % 170) / 2.0::DOUBLE AS x, s_suppkey % 80 - 40.5::DOUBLE AS y FROM supplier)")
def source_manifest_footprints(spark: SparkSession, folder: str) -> DataFrame:
    """The footprint of a manifest's coordinates, its corners and box."""
    s = table(spark, folder, "supplier").select("s_suppkey", (F.pmod("s_suppkey", F.lit(170)) / 2.0).alias("x"), (F.pmod("s_suppkey", F.lit(80)) - 40.5).alias("y"))
    at = lambda a, b: F.concat_ws(",", (F.col("y") + b).cast("string"), (F.col("x") + a).cast("string"))
    text = F.concat(F.lit("<safe><footPrint><gml:coordinates>"), F.concat_ws(" ", at(0, 0), at(2.5, 0), at(2.5, 1.25), at(0, 1.25)), F.lit("</gml:coordinates></footPrint></safe>"))
    p = s.select("s_suppkey", XM.footprint(text).alias("p"))
    lon, lat = F.transform("p", lambda q: q["lon"]), F.transform("p", lambda q: q["lat"])
    return p.select(F.col("s_suppkey").alias("scene"), F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"), F.size("p").cast("long").alias("n_points"))


# --- maps of the decay ---

BOX = (3, 40, 5, 24)


@query(WITH + fit_sql("SELECT part, season, lag, avg(coh) / 100 AS coh FROM samples WHERE coh > 0 AND coh < 255 GROUP BY part, season, lag", "part, season") + f"""SELECT season, round(avg(g_inf + (g0 - g_inf) * exp(-24.0::DOUBLE / tau)), 5) AS coh, round(avg(g_inf), 5) AS floor, count(*) AS n
FROM fitted WHERE part % 2 = 0 AND season IN ('winter', 'summer') AND part // 32 BETWEEN {BOX[0]} AND {BOX[1]} AND part % 32 BETWEEN {BOX[2]} AND {BOX[3]}
AND season IN (SELECT season FROM fitted WHERE part % 2 = 0 GROUP BY season HAVING {(BOX[0] + BOX[1]) // 2} BETWEEN min(part // 32) AND max(part // 32) AND {(BOX[2] + BOX[3]) // 2} BETWEEN min(part % 32) AND max(part % 32)) GROUP BY season""")
def coherence_map_store(spark: SparkSession, folder: str) -> DataFrame:
    """Maps fitted and stored by season and polarization; those of an area that the stored map covers read and evaluated."""
    s = samples(spark, folder).where("coh > 0 AND coh < 255")
    fits = K.fit_pixels(s.groupBy("part", "season", "lag").agg((F.avg("coh") / 100).alias("coh")), ["part", "season"], LEVELS).where("n_lags >= 3")
    maps = fits.select("season", F.when(F.col("part") % 2 == 0, "VV").otherwise("VH").alias("pol"), F.floor(F.col("part") / 32).alias("row"), (F.col("part") % 32).alias("col"), "g_inf", "g0", "tau")
    with temporary(spark) as keep:
        path = place(spark, "maps")
        S.write_decay_maps(maps, path)
        wanted = S.read_decay_maps(spark, path, ["winter", "summer"], "VV", BOX)
        whole = S.read_decay_maps(spark, path, ["winter", "summer"], "VV")
        fresh = K.covers(whole, (BOX[0] + BOX[1]) // 2, (BOX[2] + BOX[3]) // 2)
        c = decay(F.col("g_inf"), F.col("g0"), F.col("tau"), F.lit(24.0))
        got = wanted.join(F.broadcast(fresh), "season", "left_semi").groupBy("season")  # one row a season
        return keep(got.agg(F.round(F.avg(c), 5).alias("coh"), F.round(F.avg("g_inf"), 5).alias("floor"), F.count("*").alias("n")), "evaluated")


# --- export ---


@query("""SELECT file, band, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (
SELECT 'geo_velocity' || CASE WHEN layer = 0 THEN '' ELSE '_velocityStd' END AS file, CASE WHEN layer = 0 THEN 'velocity' ELSE 'velocityStd' END AS band, CASE WHEN v % 7 = 0 OR v % 11 = 0 OR v = 13 THEN -9999 ELSE v END AS value FROM pixels WHERE layer IN (0, 1)
UNION ALL SELECT 'timeseries', CASE WHEN layer = 2 THEN '20240101' ELSE '20240113' END, CASE WHEN v % 7 = 0 OR v % 11 = 0 OR v = 13 THEN -9999 ELSE v END FROM pixels WHERE layer IN (2, 3)
UNION ALL SELECT 'geo_maskTempCoh', 'maskTempCoh', CASE WHEN v % 7 = 0 OR v % 11 = 0 OR v = 13 THEN 255 ELSE abs(v) % 2 END FROM pixels WHERE layer = 4) GROUP BY 1, 2""")
def sink_product_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Products written as named bands and read back: rates split by layer, a band a date, masks as bytes."""
    k = F.col("layer")
    of = lambda *by: F.element_at(F.array(*map(F.lit, by)), (k + 1).cast("int"))
    v = F.when(F.pmod("v", F.lit(7)) == 0, F.lit(float("nan"))).when(F.pmod("v", F.lit(11)) == 0, F.lit(float("-inf"))).when((k == 4) & (F.col("v") != 13), F.abs("v") % 2).otherwise(F.col("v").cast("double"))
    p = pixels(spark, folder).where("layer < 6").select(
        of("geo_velocity", "geo_velocity", "timeseries", "timeseries", "geo_maskTempCoh", "geo_velocity").alias("product"), of("velocity", "velocityStd", "timeseries", "timeseries", "maskTempCoh", "other").alias("dataset"),
        of("", "", "20240101", "20240113", "", "").alias("date"), "row", "col", v.alias("value"), F.lit(13.0).alias("no_data"),
    )
    with temporary(spark) as keep:
        path = place(spark, "bands")
        S.write_bands(p, path)
        return keep(S.read_bands(spark, path).groupBy("file", "band").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "exported")


# --- lists of pairs and archives ---


@query(WITH + """, dated AS (SELECT stack, scene, CASE WHEN scene % 37 <> 0 THEN t END AS t, bperp_m FROM collapsed)
SELECT DISTINCT a.stack, CASE WHEN (a.t, a.scene) < (b.t, b.scene) THEN a.scene ELSE b.scene END AS ref, CASE WHEN (a.t, a.scene) < (b.t, b.scene) THEN b.scene ELSE a.scene END AS sec, abs(a.t - b.t) AS dt_days
FROM dated a JOIN dated b ON a.stack = b.stack AND a.scene <> b.scene WHERE a.scene % 100 = 0 AND a.t IS NOT NULL AND b.t IS NOT NULL""")
def network_pairs_of_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """All combinations of the scenes asked for (ids divisible by 100) with those of their stack, in order of date, undated ones dropped."""
    s = collapsed(spark, folder).withColumn("t", F.when(F.col("scene") % 37 != 0, F.col("t")))
    return P.pairs_of(s.where("scene % 100 = 0"), s).select("stack", "ref", "sec", "dt_days")


@query("""SELECT archive, count(*) AS n_members, CAST(count(DISTINCT k) AS BIGINT) AS n_kinds, arg_min(w, path) AS west, arg_min(w + 1.5, path) AS east, arg_min(s, path) AS south, arg_min(s + 2, path) AS north
FROM (SELECT c_nationkey AS archive, c_custkey % 4 AS k, 'p' || c_custkey || '_' AS path, c_custkey % 90 / 2.0::DOUBLE AS w, c_custkey % 60 / 4.0::DOUBLE AS s FROM customer WHERE c_custkey % 4 <> 3) GROUP BY archive""")
def source_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rasters of archives classified by name, each path once, with the bounds of each archive's first."""
    c = table(spark, folder, "customer")
    end = F.element_at(F.array(*map(F.lit, ("_unw_phase.tif", "_corr.tif", "_dem.tif", "_browse.png"))), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    west, south = F.pmod("c_custkey", F.lit(90)) / 2.0, F.pmod("c_custkey", F.lit(60)) / 4.0
    m = c.select(F.col("c_nationkey").alias("archive"), F.concat(F.lit("p"), "c_custkey", end).alias("path"), west.alias("west"), south.alias("south"), (west + 1.5).alias("east"), (south + 2).alias("north"))
    return S.archives(m.unionAll(m)).select("archive", "n_members", F.size("kinds").cast("long").alias("n_kinds"), "west", "east", "south", "north")
