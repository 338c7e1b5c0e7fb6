"""Registered queries: pixel tables, geometry, network inversion and time series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..functions import geo as G
from ..operators import inversion as I
from ..operators import pairs as P
from ..operators import pixels as X
from .adapters import collapsed, pixels, samples, table
from .registry import query


@query("SELECT layer, row, col, v FROM pixels WHERE row BETWEEN 10 AND 90 AND col BETWEEN 5 AND 70")
def pixel_crop(spark: SparkSession, folder: str) -> DataFrame:
    """A window of rows and columns."""
    return X.crop(pixels(spark, folder), 10, 90, 5, 70).select("layer", "row", "col", "v")


@query("SELECT max(r0) AS row0, min(r1) AS row1, max(c0) AS col0, min(c1) AS col1, min(r0) AS u_row0, max(r1) AS u_row1, min(c0) AS u_col0, max(c1) AS u_col1 FROM (SELECT layer, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pixels GROUP BY layer)")
def pixel_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """What all layers cover, and what any covers."""
    e = X.extents(pixels(spark, folder))
    u = X.union_extent(e).select(*(F.col(c).alias(f"u_{c}") for c in ("row0", "row1", "col0", "col1")))
    return X.common_overlap(e).crossJoin(u)  # one row each


@query("SELECT layer, CASE WHEN ok THEN greatest(r0, 30) END AS row0, CASE WHEN ok THEN least(r1, 50) END AS row1, CASE WHEN ok THEN greatest(c0, 100) END AS col0, CASE WHEN ok THEN least(c1, 300) END AS col1 FROM (SELECT *, greatest(r0, 30) <= least(r1, 50) AND greatest(c0, 100) <= least(c1, 300) AS ok FROM (SELECT tile AS layer, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pixels GROUP BY tile))")
def pixel_window(spark: SparkSession, folder: str) -> DataFrame:
    """Each tile's part of a window, null where they don't meet."""
    e = X.extents(pixels(spark, folder), "tile").withColumnRenamed("tile", "layer")
    return X.intersect_window(e, 30, 50, 100, 300)


@query("SELECT row % 200 AS row, col, arg_min(v, layer * 1000000 + row) AS v FROM pixels WHERE v > 0 GROUP BY row % 200, col")
def pixel_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid value of each cell of overlapping bursts."""
    p = pixels(spark, folder).withColumn("ord", F.col("layer") * 1000000 + F.col("row")).withColumn("row", F.pmod("row", F.lit(200)))
    return X.mosaic(p, "ord", F.col("v") > 0).select("row", "col", "v")


@query("SELECT layer, row // 4 AS row, col // 4 AS col, round(avg(v), 6) AS v, count(v) AS n FROM pixels GROUP BY 1, 2, 3")
def pixel_multilook(spark: SparkSession, folder: str) -> DataFrame:
    """Means of 4 x 4 blocks."""
    return X.multilook(pixels(spark, folder), 4, 4).withColumn("v", F.round("v", 6))


@query("SELECT tile, round(avg(CASE WHEN v < -150 THEN 1.0 ELSE 0.0 END), 9) AS nan_fraction FROM pixels GROUP BY tile")
def pixel_nan_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Share of invalid pixels."""
    p = pixels(spark, folder).withColumn("v", F.when(F.col("v") < -150, F.lit(float("nan"))).otherwise(F.col("v").cast("double")))
    return X.nan_fraction(p, "tile").withColumn("nan_fraction", F.round("nan_fraction", 9))


@query("SELECT pair, round(avg(coh), 6) AS mean_coherence, count(*) AS n FROM samples WHERE coh > 0 GROUP BY pair")
def pixel_pair_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean coherence of each pair's valid pixels."""
    return samples(spark, folder).where("coh > 0").groupBy("pair").agg(F.round(F.avg("coh"), 6).alias("mean_coherence"), F.count("*").alias("n"))


CLASSES = {"forest": 10, "shrub": 20, "grass": 30, "crop": 40, "urban": 50}


@query("SELECT brand, round(sum(CASE WHEN cls = 10 THEN n ELSE 0 END) / sum(n), 6) AS lc_forest_fraction, round(sum(CASE WHEN cls = 20 THEN n ELSE 0 END) / sum(n), 6) AS lc_shrub_fraction, round(sum(CASE WHEN cls = 30 THEN n ELSE 0 END) / sum(n), 6) AS lc_grass_fraction, round(sum(CASE WHEN cls = 40 THEN n ELSE 0 END) / sum(n), 6) AS lc_crop_fraction, round(sum(CASE WHEN cls = 50 THEN n ELSE 0 END) / sum(n), 6) AS lc_urban_fraction, CAST(coalesce(arg_max(cls, n * 1000 - cls) FILTER (WHERE cls IN (10, 20, 30, 40, 50)), -1) AS BIGINT) AS dominant FROM (SELECT p_brand AS brand, CAST(p_size // 8 * 10 AS BIGINT) AS cls, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY brand")
def pixel_class_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of classes of all pixels and the dominant known class."""
    p = table(spark, folder, "part").select(F.col("p_brand").alias("brand"), (F.floor(F.col("p_size") / 8) * 10).cast("long").alias("cls"))
    return X.class_fractions(p, "brand", CLASSES)


@query("SELECT row // 4 AS row, col // 4 AS col, arg_max(cls, c * 1000 - cls) AS cls, CAST(sum(c) AS BIGINT) AS n FROM (SELECT row, col, cls, count(*) AS c FROM (SELECT row // 4 * 4 AS row, col // 4 * 4 AS col, CAST((abs(v) // 40) AS BIGINT) AS cls FROM pixels) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def pixel_majority(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent class of each coarse cell."""
    return X.majority(pixels(spark, folder).withColumn("cls", F.floor(F.abs("v") / 40)), 4)


GRADIENT = "CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2.0 END / 30.0"


@query(f"SELECT tile, round(avg(slope), 6) AS slope_mean, round(quantile_cont(slope, 0.9), 6) AS slope_p90, max(v) - min(v) AS relief, round(avg(aspect), 5) AS aspect_mean FROM (SELECT tile, v, (degrees(atan2(-({GRADIENT.format(w='c')}), {GRADIENT.format(w='r')})) + 360) % 360 AS aspect, degrees(atan(sqrt(power({GRADIENT.format(w='c')}, 2) + power({GRADIENT.format(w='r')}, 2)))) AS slope FROM pixels WINDOW r AS (PARTITION BY tile, col ORDER BY row), c AS (PARTITION BY tile, row ORDER BY col)) GROUP BY tile")
def pixel_terrain(spark: SparkSession, folder: str) -> DataFrame:
    """Slope and aspect by central differences, one-sided at the edges; means, 90th percentile, relief."""
    p = pixels(spark, folder).drop("layer").withColumnRenamed("tile", "layer")
    g = X.gradients(p, 30.0).groupBy("layer").agg(F.round(F.avg("slope"), 6).alias("slope_mean"), F.round(F.percentile("slope", 0.9), 6).alias("slope_p90"), F.round(F.avg("aspect"), 5).alias("aspect_mean"))
    return g.join(p.groupBy("layer").agg((F.max("v") - F.min("v")).alias("relief")), "layer").withColumnRenamed("layer", "tile")


@query("SELECT a.tile, a.row, a.col, round(sqrt(greatest(0, avg(b.v * b.v) - avg(b.v) * avg(b.v))), 5) AS roughness FROM pixels a JOIN pixels b ON a.tile = b.tile AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3")
def pixel_roughness(spark: SparkSession, folder: str) -> DataFrame:
    """Deviation over 3 x 3 neighbours."""
    p = pixels(spark, folder).drop("layer").withColumnRenamed("tile", "layer")
    return X.roughness(p).select(F.col("layer").alias("tile"), "row", "col", F.round("roughness", 5).alias("roughness"))


@query("SELECT tile, round(avg(roughness), 5) AS roughness_mean FROM (SELECT a.tile, a.row, a.col, sqrt(greatest(0, avg(b.v * b.v) - avg(b.v) * avg(b.v))) AS roughness FROM pixels a JOIN pixels b ON a.tile = b.tile AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3) GROUP BY tile")
def pixel_roughness_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean roughness of each tile."""
    p = pixels(spark, folder).drop("layer").withColumnRenamed("tile", "layer")
    return X.roughness(p).groupBy(F.col("layer").alias("tile")).agg(F.round(F.avg("roughness"), 5).alias("roughness_mean"))


@query("SELECT row, col, round(avg(v), 6) AS mean, count(*) AS n, CASE WHEN avg(v) >= 50 THEN round(avg(v), 6) END AS masked FROM (SELECT layer, row % 64 AS row, col, v FROM pixels) GROUP BY row, col")
def pixel_stack_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the stack, masked under a threshold."""
    p = pixels(spark, folder).withColumn("row", F.pmod("row", F.lit(64)))
    return X.stack_mean(p, 50).select("row", "col", F.round("mean", 6).alias("mean"), "n", F.round("masked", 6).alias("masked"))


@query("SELECT layer, round(CASE WHEN p2 >= p98 THEN lo ELSE p2 END, 6) AS vmin, round(CASE WHEN p2 >= p98 THEN hi ELSE p98 END, 6) AS vmax, round(a98, 6) AS abs98 FROM (SELECT layer, quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.98) AS p98, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, quantile_cont(abs(v), 0.98) AS a98 FROM pixels GROUP BY layer)")
def pixel_display_range(spark: SparkSession, folder: str) -> DataFrame:
    """Exact display percentiles."""
    return X.display_range(pixels(spark, folder)).select("layer", *(F.round(c, 6).alias(c) for c in ("vmin", "vmax", "abs98")))


@query("SELECT layer, row, col, v FROM pixels WHERE row % 2 = 0 AND col % 2 = 0")
def pixel_preview(spark: SparkSession, folder: str) -> DataFrame:
    """T4: evenly thinned rows and columns."""
    return X.decimated(pixels(spark, folder).drop("tile"), 512, 512)


@query("SELECT layer, count(*) AS n, round(avg(CASE WHEN v % 5 = 0 THEN 1.0 ELSE 0.0 END), 9) AS masked_share FROM (SELECT layer, v FROM pixels) GROUP BY layer")
def pixel_water_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Polarity of a water mask and the share it masks; here multiples of five are land."""
    m = X.water_mask(pixels(spark, folder).withColumn("v", F.pmod("v", F.lit(5))))
    return m.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("valid"), 9).alias("masked_share"))


IMAGES = """, slc AS (SELECT layer, row % 64 AS row, col, sum(v) AS re, sum(v * (col % 3) - row % 7) AS im FROM pixels GROUP BY 1, 2, 3),
ifg AS (SELECT a.layer AS ref, b.layer AS sec, a.row, a.col, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS p_ref, b.re * b.re + b.im * b.im AS p_sec FROM slc a JOIN slc b ON b.layer BETWEEN a.layer + 1 AND a.layer + 2 AND a.row = b.row AND a.col = b.col)
"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder)
    return p.groupBy("layer", F.pmod("row", F.lit(64)).alias("row"), "col").agg(F.sum("v").alias("re"), F.sum(F.col("v") * F.pmod("col", F.lit(3)) - F.pmod("row", F.lit(7))).alias("im"))


def image_pairs(slc: DataFrame) -> DataFrame:
    layers = slc.select("layer").distinct()
    return layers.select(F.col("layer").alias("ref"), F.explode(F.array(F.col("layer") + 1, F.col("layer") + 2)).alias("sec")).join(layers.withColumnRenamed("layer", "sec"), "sec", "left_semi")


def with_images(sql: str) -> str:
    from .adapters import WITH

    return WITH + IMAGES + sql


@query(with_images("SELECT ref, sec, row, col, CAST(re AS BIGINT) AS re, CAST(im AS BIGINT) AS im FROM ifg"))
def pixel_interferograms(spark: SparkSession, folder: str) -> DataFrame:
    """Products with the conjugate on shared pixels."""
    s = images(spark, folder)
    return X.interferograms(s, image_pairs(s)).select("ref", "sec", "row", "col", F.col("re").cast("long").alias("re"), F.col("im").cast("long").alias("im"))


BOX = "OVER (PARTITION BY ref, sec, {p} ORDER BY {o} RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


def box(columns: str, source: str, along: str, across: str) -> str:
    sums = ", ".join(f"sum({c}) {BOX.format(p=across, o=along)} AS {c}" for c in columns.split())
    return f"SELECT ref, sec, row, col, {sums} FROM {source}"


@query(with_images(f"SELECT ref, sec, row, col, round(sqrt(power(re, 2) + power(im, 2)) / sqrt(p_ref * p_sec), 6) AS coherence FROM ({box('re im p_ref p_sec', '(' + box('re im p_ref p_sec', 'ifg', 'col', 'row') + ')', 'row', 'col')})"))
def pixel_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence over 11 x 11 boxes, for all pixels of all pairs."""
    s = images(spark, folder)
    return X.coherence(X.interferograms(s, image_pairs(s))).select("ref", "sec", "row", "col", F.round("coherence", 6).alias("coherence"))


@query("SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, tile FROM (SELECT c_custkey, (n + h) * cos(radians(la)) * cos(radians(lo)) AS x, (n + h) * cos(radians(la)) * sin(radians(lo)) AS y, (n * (1 - 0.0066943799901413165) + h) * sin(radians(la)) AS z, (CASE WHEN floor(la) >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(CAST(floor(la) AS INT)) AS VARCHAR), 2, '0') || (CASE WHEN floor(lo) >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(CAST(floor(lo) AS INT)) AS VARCHAR), 3, '0') AS tile FROM (SELECT *, 6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * power(sin(radians(la)), 2)) AS n FROM (SELECT c_custkey, CAST(c_custkey % 160 AS DOUBLE) - 80 AS la, CAST(c_custkey % 350 AS DOUBLE) - 175 AS lo, c_acctbal AS h FROM customer)))")
def geo_ecef(spark: SparkSession, folder: str) -> DataFrame:
    """Geodetic to earth-centred coordinates; tile names."""
    c = table(spark, folder, "customer")
    la, lo = F.pmod("c_custkey", F.lit(160)).cast("double") - 80, F.pmod("c_custkey", F.lit(350)).cast("double") - 175
    return c.select("c_custkey", G.ecef(la, lo, F.col("c_acctbal")).alias("p"), F.concat(N.tile_lat(la), N.tile_lon(lo)).alias("tile")).select("c_custkey", *(F.round(f"p.{k}", 3).alias(k) for k in "xyz"), "tile")


@query("SELECT s_suppkey, CAST(w AS BIGINT) AS west, CAST(s AS BIGINT) AS south, CAST(w + 4 AS BIGINT) AS east, CAST(s + 3 AS BIGINT) AS north, round(w + 1.6, 9) AS lon, round(s + 1.2, 9) AS lat, true AS inside_center, false AS inside_out FROM (SELECT s_suppkey, s_suppkey % 100 AS w, s_suppkey % 60 AS s FROM supplier)")
def geo_wkt(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes to WKT and back; the mean of all vertices, the closing one twice; points in polygons."""
    s = table(spark, folder, "supplier").select("s_suppkey", F.pmod("s_suppkey", F.lit(100)).alias("w"), F.pmod("s_suppkey", F.lit(60)).alias("s"))
    p = s.withColumn("p", G.wkt_points(G.box_wkt(F.col("w"), F.col("s"), F.col("w") + 4, F.col("s") + 3)))
    box, mid = G.points_box(F.col("p")), G.points_mean(F.col("p"))
    whole = lambda k: box[k].cast("long").alias(k)
    return p.select("s_suppkey", whole("west"), whole("south"), whole("east"), whole("north"), F.round(mid["lon"], 9).alias("lon"), F.round(mid["lat"], 9).alias("lat"), G.inside(F.col("p"), F.col("w") + 2, F.col("s") + 1).alias("inside_center"), G.inside(F.col("p"), F.col("w") + 5, F.col("s") + 1).alias("inside_out"))


@query("SELECT c_custkey, round(greatest(0, least(e1, e2) - greatest(w1, w2)) * greatest(0, least(n1, n2) - greatest(s1, s2)) / ((e1 - w1) * (n1 - s1)), 9) AS coverage FROM (SELECT c_custkey, 10.0 AS w1, 10.0 AS s1, 14.0 AS e1, 13.0 AS n1, CAST(c_custkey % 16 AS DOUBLE) AS w2, CAST(c_custkey % 14 AS DOUBLE) AS s2, CAST(c_custkey % 16 + 3 AS DOUBLE) AS e2, CAST(c_custkey % 14 + 2 AS DOUBLE) AS n2 FROM customer) WHERE least(e1, e2) > greatest(w1, w2) AND least(n1, n2) > greatest(s1, s2)")
def geo_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """F8: share of the area of interest that a scene's box covers."""
    c = table(spark, folder, "customer")
    w, s = F.pmod("c_custkey", F.lit(16)).cast("double"), F.pmod("c_custkey", F.lit(14)).cast("double")
    return c.select("c_custkey", F.round(G.box_overlap(F.lit(10.0), F.lit(10.0), F.lit(14.0), F.lit(13.0), w, s, w + 3, s + 2), 9).alias("coverage")).where("coverage > 0")


@query("SELECT c_custkey, round(sqrt(greatest(0, least(1, 1 - e * e - n * n))), 9) AS up, round(CASE WHEN sqrt(greatest(0, least(1, 1 - e * e - n * n))) > 1e-6 THEN 5 / sqrt(greatest(0, least(1, 1 - e * e - n * n))) END, 6) AS vertical, round(c_acctbal * (-0.05546576::DOUBLE / (4 * pi())), 6) AS metres FROM (SELECT c_custkey, c_acctbal, CAST(c_custkey % 10 AS DOUBLE) / 10 AS e, CAST(c_custkey % 7 AS DOUBLE) / 10 AS n FROM customer)")
def geo_line_of_sight(spark: SparkSession, folder: str) -> DataFrame:
    """Upward part of the line of sight, vertical values, phase to metres."""
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", (F.pmod("c_custkey", F.lit(10)).cast("double") / 10).alias("e"), (F.pmod("c_custkey", F.lit(7)).cast("double") / 10).alias("n"))
    up = G.los_up(F.col("e"), F.col("n"))
    return c.select("c_custkey", F.round(up, 9).alias("up"), F.round(G.vertical(F.lit(5.0), up), 6).alias("vertical"), F.round(G.phase_to_metres(F.col("c_acctbal")), 6).alias("metres"))


@query("SELECT s_suppkey, CAST(floor((k - 2.0) / 10) * 10 AS BIGINT) AS lo, CAST(ceil((k + 7.0) / 10) * 10 AS BIGINT) AS hi, CAST(greatest(0, least(99, round_even((k - 3) / 0.7, 0))) AS INT) AS idx, CAST(CASE WHEN k % 3 = 0 THEN 32600 + k % 60 + 1 WHEN k % 3 = 1 THEN 32700 + k % 60 + 1 ELSE 4326 END AS INT) AS epsg FROM (SELECT s_suppkey, s_suppkey % 90 AS k FROM supplier)")
def geo_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes snapped outward, pixel indices, coordinate systems."""
    k = F.pmod("s_suppkey", F.lit(90))
    lo, hi = G.snapped(k, k + 5, 2.0, 10)
    zone = F.concat((F.pmod(k, F.lit(60)) + 1).cast("string"), F.when(k % 3 == 0, "N").otherwise("S"))
    epsg = G.epsg_of(F.lit(None).cast("string"), F.when(k % 3 != 2, zone), F.lit(1.0), F.lit("degrees"))
    return table(spark, folder, "supplier").select("s_suppkey", lo.alias("lo"), hi.alias("hi"), G.pixel_index(k, 3, 0.7, 100).alias("idx"), epsg.cast("int").alias("epsg"))


# --- inversion ---


def shifts(spark: SparkSession, folder: str) -> DataFrame:
    p = P.sequential(collapsed(spark, folder), 3).join(collapsed(spark, folder).select(F.col("scene").alias("ref"), F.col("t").alias("t_ref")), "ref")
    shift = (F.sin((F.col("t_ref") + F.col("dt_days")) / 50) - F.sin(F.col("t_ref") / 50)) * 0.01
    return p.select("stack", "t_ref", (F.col("t_ref") + F.col("dt_days")).alias("t_sec"), F.when(F.pmod(F.col("ref") + F.col("sec"), F.lit(11)) != 0, shift).alias("shift"))


@query()
def inversion_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of dates from pair shifts, some of which failed."""
    c = I.date_corrections(shifts(spark, folder))
    return c.select("stack", "t", F.round("correction", 8).alias("correction"), "rank", "full_rank", "n_used", "n_failed")


@query()
def inversion_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Which corrections are to be applied."""
    return I.applied(I.date_corrections(shifts(spark, folder))).select("stack", "t", F.round("correction", 8).alias("correction"), "use")


@query("SELECT stack, t_ref, t_sec, round(median(x), 9) AS shift, count(*) AS n FROM (SELECT a.stack, a.t AS t_ref, b.t AS t_sec, (s.scene % 100) / 1000.0::DOUBLE AS x FROM collapsed a JOIN collapsed b ON a.stack = b.stack AND b.t - a.t BETWEEN 1 AND 12 JOIN collapsed s ON s.stack = a.stack AND s.t BETWEEN a.t AND a.t + 60) GROUP BY 1, 2, 3")
def inversion_measured(spark: SparkSession, folder: str) -> DataFrame:
    """The median of a pair's samples."""
    c = collapsed(spark, folder)
    p = P.all_pairs(c, 12)
    s = c.select("stack", F.col("t").alias("t_s"), (F.pmod("scene", F.lit(100)) / 1000.0).alias("x")).withColumn("t_ref", F.explode(F.sequence(F.col("t_s") - 60, F.col("t_s"))))
    return p.join(s, ["stack", "t_ref"]).groupBy("stack", "t_ref", "t_sec").agg(F.round(F.median("x"), 9).alias("shift"), F.count("*").alias("n"))


T_DATES = [0, 12, 24, 48, 60]
NETWORK = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3), (2, 4)]


def summed(spark: SparkSession, folder: str) -> DataFrame:
    """(row, col, v): the layers' sum at each pixel.

    Layers seldom share pixels, so adding up in the tasks that read a file would hold all pixels of its part of the file.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pixels(spark, folder).repartition(n, "row", "col").groupBy("row", "col").agg(F.sum("v").alias("v"))


def phases(spark: SparkSession, folder: str) -> DataFrame:
    """(row, col, phase, weight): a line through time per pixel, with masked pairs and a turn's error in some."""
    cube = summed(spark, folder)
    rate = F.col("v") / 100_000.0
    one = lambda k, i, j: F.when(F.pmod(F.col("row") * 7 + F.col("col") * 3 + k, F.lit(13)) != 0, rate * (T_DATES[j] - T_DATES[i]) + F.when(F.pmod(F.col("row") + F.col("col") + k, F.lit(29)) == 0, 2 * np.pi).otherwise(0.0))
    weight = F.array(*(F.lit(1.0 + k / 10) for k in range(len(NETWORK))))
    return cube.select("row", "col", F.array(*(one(k, i, j) for k, (i, j) in enumerate(NETWORK))).alias("phase"), weight.alias("weight"))


@query()
def inversion_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Displacement of dates by least squares, pairs used, temporal coherence and its mask."""
    ts = I.invert_pixels(phases(spark, folder), NETWORK, T_DATES)
    return ts.where("n_used >= 4").select("row", "col", "n_used", F.round("coherence", 6).alias("coherence"), "t", F.round("value", 6).alias("value"))


@query()
def inversion_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted least squares."""
    ts = I.invert_pixels(phases(spark, folder), NETWORK, T_DATES, weighted=True)
    return ts.select("row", "col", "t", F.round("value", 6).alias("value"))


CUBE = """, cube AS (SELECT row, col, sum(v) AS v FROM pixels GROUP BY row, col), ts AS (SELECT row, col, t, v * t / 1000.0::DOUBLE + row * t / 500.0 + (row * col + t) % 7 AS value, CAST((row * 31 + col * 17) % 101 AS DOUBLE) / 100 AS quality FROM cube, (SELECT unnest([0, 12, 24, 48, 60]) AS t))
"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    cube = summed(spark, folder)
    ts = cube.withColumn("t", F.explode(F.array(*map(F.lit, T_DATES))))
    value = F.col("v") * F.col("t") / 1000.0 + F.col("row") * F.col("t") / 500.0 + F.pmod(F.col("row") * F.col("col") + F.col("t"), F.lit(7))
    return ts.select("row", "col", "t", value.alias("value"), (F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(101)).cast("double") / 100).alias("quality"))


def with_cube(sql: str) -> str:
    from .adapters import WITH

    return WITH + CUBE + sql


@query(with_cube("SELECT row, col, t, round(value - first_value(value) OVER (PARTITION BY t ORDER BY quality DESC, row, col), 6) + 0.0 AS value FROM ts"))
def series_reference_point(spark: SparkSession, folder: str) -> DataFrame:
    """I8: values less those of the pixel of best quality."""
    ts = series(spark, folder)
    q = ts.where("t = 0").select("row", "col", "quality")
    return I.to_reference_point(ts, q).select("row", "col", "t", F.round("value", 6).alias("value"))


@query(with_cube("SELECT row, col, t, round(value - max(value) FILTER (t = 24) OVER (PARTITION BY row, col), 6) + 0.0 AS value FROM ts"))
def series_reference_date(spark: SparkSession, folder: str) -> DataFrame:
    """Values less those of a date."""
    return I.to_reference_date(series(spark, folder), 24).select("row", "col", "t", F.round("value", 6).alias("value"))


@query(with_cube("SELECT row, col, t, round((CASE WHEN t >= 12 OR row % 2 = 0 THEN value END - first(CASE WHEN t >= 12 OR row % 2 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * 1000, 4) + 0.0 AS value FROM ts").replace("first(", "first_value("))
def series_first_finite(spark: SparkSession, folder: str) -> DataFrame:
    """Values less the first that is finite, in millimetres."""
    ts = series(spark, folder).withColumn("value", F.when((F.col("t") >= 12) | (F.col("row") % 2 == 0), F.col("value")))
    return I.to_first_finite(ts, 1000).select("row", "col", "t", F.round("value", 4).alias("value"))


@query(with_cube("SELECT row, col, t, value FROM (SELECT row, col, t, round(value, 6) AS value FROM ts WHERE row = 17 AND col = 23)"))
def series_of_pixel(spark: SparkSession, folder: str) -> DataFrame:
    """One pixel's series in order of date."""
    return series(spark, folder).where("row = 17 AND col = 23").select("row", "col", "t", F.round("value", 6).alias("value")).orderBy("t")


@query(with_cube("SELECT row, col, round(regr_slope(value, t / 365.25::DOUBLE), 5) AS velocity, round(regr_intercept(value, t / 365.25::DOUBLE), 6) AS intercept, count(*) AS n FROM ts GROUP BY row, col"))
def series_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Velocities by straight lines."""
    v = I.velocity(series(spark, folder))
    return v.select("row", "col", F.round("velocity", 5).alias("velocity"), F.round("intercept", 6).alias("intercept"), "n")


@query(with_cube("SELECT row, col, round(regr_slope(value, t / 365.25::DOUBLE), 5) AS velocity, round(sqrt(greatest(0, regr_syy(value, t / 365.25::DOUBLE) - power(regr_sxy(value, t / 365.25::DOUBLE), 2) / regr_sxx(value, t / 365.25::DOUBLE)) / 3 / regr_sxx(value, t / 365.25::DOUBLE)), 4) AS std FROM ts GROUP BY row, col"))
def series_velocity_std(spark: SparkSession, folder: str) -> DataFrame:
    """Standard errors of velocities from residues."""
    return I.velocity(series(spark, folder)).select("row", "col", F.round("velocity", 5).alias("velocity"), F.round("velocity_std", 4).alias("std"))


@query()
def series_velocity_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of velocities over resampled dates."""
    return I.bootstrap_velocity(series(spark, folder), 40).select("row", "col", F.round("velocity_std", 6).alias("velocity_std"), "n")


PLANE = """SELECT row, col, t, round(value - mv - (row - mr) * (rv * cc - cv * rc) / (rr * cc - rc * rc) - (col - mc) * (cv * rr - rv * rc) / (rr * cc - rc * rc), 5) + 0.0 AS value FROM ts JOIN (
SELECT t, avg(value) AS mv, avg(row) AS mr, avg(col) AS mc, var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc, covar_pop(row, value) AS rv, covar_pop(col, value) AS cv FROM ts GROUP BY t) USING (t)"""


@query(with_cube(PLANE))
def series_deramped(spark: SparkSession, folder: str) -> DataFrame:
    """A plane of each date taken from its pixels."""
    return I.deramped(series(spark, folder)).select("row", "col", "t", (F.round("value", 5) + 0.0).alias("value"))


@query(with_cube("SELECT row, col, t, round(value - i - s * (row * 10 + col % 5), 5) + 0.0 AS value FROM ts JOIN (SELECT t, regr_intercept(value, row * 10 + col % 5) AS i, regr_slope(value, row * 10 + col % 5) AS s FROM ts GROUP BY t) USING (t)"))
def series_height_correlated(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each date that goes with height (here a function of the row) taken out."""
    return I.without_height(series(spark, folder), "row * 10 + col % 5").select("row", "col", "t", (F.round("value", 5) + 0.0).alias("value"))


@query(with_cube("SELECT t, round(sqrt(avg(value * value)), 6) AS rms FROM ts GROUP BY t"))
def series_residual_rms(spark: SparkSession, folder: str) -> DataFrame:
    """Root mean square of each date."""
    return I.residual_rms(series(spark, folder)).select("t", F.round("rms", 6).alias("rms"))


@query()
def series_functions(spark: SparkSession, folder: str) -> DataFrame:
    """A line, a step and the height error's baselines fitted to each pixel's series."""
    s = series(spark, folder).groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))
    got = I.fit_series(s, T_DATES, extra=[np.array([0.0, 30.0, -20.0, 10.0, 5.0])], names=["height_error"], poly=1, steps=[48])
    return got.select("row", "col", "name", F.round("coefficient", 5).alias("coefficient"))


@query("SELECT row, col, count(*) AS n_triplets, CAST(sum(CASE WHEN abs(bump) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous FROM (SELECT row, col, k, (CASE WHEN (row + col + 0 + k) % 29 = 0 THEN 1 ELSE 0 END) + (CASE WHEN (row + col + k + 1) % 29 = 0 THEN 1 ELSE 0 END) - (CASE WHEN (row + col + k + 4) % 29 = 0 THEN 1 ELSE 0 END) AS bump FROM (SELECT DISTINCT row, col FROM pixels), (SELECT unnest([0, 1, 2]) AS k)) GROUP BY row, col")
def series_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Triplets whose phases don't close."""
    cube = pixels(spark, folder).select("row", "col").distinct()
    spans = F.array(*(F.struct(F.lit(i).alias("ref"), F.lit(j).alias("sec"), F.lit(k).alias("k")) for k, (i, j) in enumerate(NETWORK)))
    ifg = cube.select("row", "col", F.inline(spans)).withColumn("phase", (F.col("sec") - F.col("ref")) * 0.1 + F.when(F.pmod(F.col("row") + F.col("col") + F.col("k"), F.lit(29)) == 0, 2 * np.pi).otherwise(0.0))
    return I.closure_ambiguities(ifg, ifg.select("ref", "sec").distinct())


@query("SELECT row, col, round(sum(v * d / 365.25) / sum(power(d / 365.25, 2)), 9) AS velocity, count(*) AS n FROM (SELECT row % 64 AS row, col, v, CAST(layer % 8 + 1 AS DOUBLE) * 6 AS d FROM pixels WHERE v % 9 <> 0) GROUP BY row, col")
def series_phase_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Average phase velocity of each pixel over its pairs, missing phases left out."""
    phase = F.when(F.col("v") % 9 != 0, F.col("v").cast("double"))
    p = pixels(spark, folder).select(F.pmod("row", F.lit(64)).alias("row"), "col", ((F.pmod("layer", F.lit(8)) + 1) * 6).alias("dt_days"), phase.alias("phase"))
    return I.phase_velocity(p).withColumn("velocity", F.round("velocity", 9))


@query("SELECT row, col, round(avg(v), 6) AS mean_value, count(*) AS n FROM (SELECT row % 64 AS row, col, v FROM pixels) GROUP BY row, col")
def series_average(spark: SparkSession, folder: str) -> DataFrame:
    """Average of the stack per pixel."""
    return pixels(spark, folder).groupBy(F.pmod("row", F.lit(64)).alias("row"), "col").agg(F.round(F.avg("v"), 6).alias("mean_value"), F.count("*").alias("n"))
