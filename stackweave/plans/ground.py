"""Registered queries: polygons of areas and footprints, crops and mosaics over several grids, coherence by class group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coherence as K
from ..operators import mosaics as M
from ..operators import pixels as X
from ..operators import polygons as PG
from .adapters import WITH, pixels, samples, table
from .areas import grid
from .registry import query


def corners(*at: tuple) -> Column:
    return F.array(*(F.struct((F.col("x") + a).cast("double").alias("lon"), (F.col("y") + b).cast("double").alias("lat")) for a, b in at))


#: Areas of interest: boxes, right triangles and angles (concave), by turns.
SHAPES = (((0, 0), (5, 0), (5, 4), (0, 4)), ((0, 0), (6, 0), (0, 3)), ((0, 0), (6, 0), (6, 1), (2, 1), (2, 5), (0, 5)))


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """(area, kind, points): a polygon for each supplier."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("area"), F.pmod("s_suppkey", F.lit(3)).alias("kind"), (F.pmod("s_suppkey", F.lit(170)) - 85 + F.pmod("s_suppkey", F.lit(10)) / 10).alias("x"), (F.pmod("s_suppkey", F.lit(110)) - 55 + F.pmod("s_suppkey", F.lit(7)) / 8).alias("y"))
    shape = F.when(F.col("kind") == 0, corners(*SHAPES[0])).when(F.col("kind") == 1, corners(*SHAPES[1])).otherwise(corners(*SHAPES[2]))
    return s.select("area", "kind", shape.alias("points"))


def footprints(spark: SparkSession, folder: str) -> DataFrame:
    """(scene, points): a box of 2.5 x 1.75 degrees for each customer, closed."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("scene"), (F.pmod("c_custkey", F.lit(700)) / 4 - 85).alias("x"), (F.pmod("c_custkey", F.lit(331)) / 3 - 55).alias("y"))
    return c.select("scene", corners((0, 0), (2.5, 0), (2.5, 1.75), (0, 1.75), (0, 0)).alias("points"))


# the area of a box within a right triangle comes from the area left of x and below y, by inclusion and exclusion
COVERAGE = """, a AS (SELECT CAST(s_suppkey AS BIGINT) AS area, s_suppkey % 3 AS kind, s_suppkey % 170 - 85 + (s_suppkey % 10) / 10.0::DOUBLE AS x, s_suppkey % 110 - 55 + (s_suppkey % 7) / 8.0::DOUBLE AS y FROM supplier),
f AS (SELECT CAST(c_custkey AS BIGINT) AS scene, (c_custkey % 700) / 4.0::DOUBLE - 85 AS x, (c_custkey % 331) / 3.0::DOUBLE - 55 AS y FROM customer),
boxes AS (SELECT area, x AS w, y AS s, x + 5 AS e, y + 4 AS n, 20.0 AS size FROM a WHERE kind = 0 UNION ALL SELECT area, x, y, x + 6, y + 1, 14.0 FROM a WHERE kind = 2 UNION ALL SELECT area, x, y + 1, x + 2, y + 5, 14.0 FROM a WHERE kind = 2),
in_boxes AS (SELECT area, scene, sum((least(e, f.x + 2.5) - greatest(w, f.x)) * (least(n, f.y + 1.75) - greatest(s, f.y))) / any_value(size) AS share FROM boxes JOIN f ON f.x < e AND f.x + 2.5 > w AND f.y < n AND f.y + 1.75 > s GROUP BY 1, 2),
cuts AS (SELECT area, scene, least(greatest(f.x - a.x, 0), 6) AS x0, least(greatest(f.x + 2.5 - a.x, 0), 6) AS x1, least(greatest(f.y - a.y, 0), 3) AS y0, least(greatest(f.y + 1.75 - a.y, 0), 3) AS y1 FROM a JOIN f ON f.x < a.x + 6 AND f.x + 2.5 > a.x AND f.y < a.y + 3 AND f.y + 1.75 > a.y WHERE kind = 1),
below AS (SELECT area, scene, sign, y * least(x, 6 - 2 * y) + CASE WHEN x > 6 - 2 * y THEN 3 * (x - (6 - 2 * y)) - (x * x - (6 - 2 * y) * (6 - 2 * y)) / 4 ELSE 0 END AS v
  FROM (SELECT area, scene, 1 AS sign, x1 AS x, y1 AS y FROM cuts UNION ALL SELECT area, scene, -1, x0, y1 FROM cuts UNION ALL SELECT area, scene, -1, x1, y0 FROM cuts UNION ALL SELECT area, scene, 1, x0, y0 FROM cuts)),
shares AS (SELECT area, scene, share FROM in_boxes UNION ALL SELECT area, scene, sum(sign * v) / 9 FROM below GROUP BY 1, 2)
"""


@query(WITH + COVERAGE + "SELECT area, scene, round(share, 6) AS share FROM shares WHERE share > 1e-9")
def geo_polygon_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of polygons, some concave, that footprints cover."""
    got = PG.coverage(areas(spark, folder), footprints(spark, folder), "area", "scene")
    return got.where("share > 1e-9").select("area", "scene", F.round("share", 6).alias("share"))


# shares of exactly a tenth, and bests halfway between two roundings, are common: on both sides rounding errors are taken out first
@query(WITH + COVERAGE + "SELECT area, count(*) AS n_scenes, CAST(round(CAST(max(share) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS best FROM shares WHERE share >= 0.1 - 1e-9 GROUP BY area")
def catalog_covering_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes that cover at least a tenth of an area of interest (a tenth itself counts), the best share to six decimals, halves up."""
    got = PG.covered(areas(spark, folder), footprints(spark, folder), "area", "scene", 0.1)
    return got.groupBy("area").agg(F.count("*").alias("n_scenes"), F.round(F.max("share").cast("decimal(18,9)"), 6).cast("double").alias("best"))


def small_areas(spark: SparkSession, folder: str) -> DataFrame:
    """(area, points): polygons of a degree or less within a square of two degrees; every fifth is a sliver without a centre."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("area"), (F.pmod("s_suppkey", F.lit(13)) / 10 + 0.03).alias("x"), (F.pmod("s_suppkey", F.lit(11)) / 10 + 0.04).alias("y"))
    sliver = corners((0, 0), (0.3, 0.01), (0, 0.02))
    shape = F.when(F.col("area") % 5 == 0, sliver).when(F.col("area") % 2 == 0, corners((0, 0), (0.6, 0.15), (0.25, 0.35), (0.3, 0.7))).otherwise(corners((0, 0), (0.5, 0), (0.4, 0.42)))
    return s.select("area", shape.alias("points"))


SMALL = """, s AS (SELECT CAST(s_suppkey AS BIGINT) AS area, (s_suppkey % 13) / 10.0::DOUBLE + 0.03 AS x, (s_suppkey % 11) / 10.0::DOUBLE + 0.04 AS y FROM supplier),
points AS (SELECT area, x, y, CASE WHEN area % 5 = 0 THEN [[0, 0], [0.3, 0.01], [0, 0.02]] WHEN area % 2 = 0 THEN [[0, 0], [0.6, 0.15], [0.25, 0.35], [0.3, 0.7]] ELSE [[0, 0], [0.5, 0], [0.4, 0.42]] END AS p FROM s),
sides AS (SELECT area, x + p[k][1] AS x0, y + p[k][2] AS y0, x + p[k % len(p) + 1][1] AS x1, y + p[k % len(p) + 1][2] AS y1 FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM points)),
centres AS (SELECT i, j, i / 10.0::DOUBLE AS lat, j / 10.0::DOUBLE AS lon FROM range(0, 25) r(i), range(0, 25) t(j)),
inside AS (SELECT area, i, j FROM sides JOIN centres ON (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) GROUP BY area, i, j HAVING count(*) % 2 = 1),
in_cells AS (SELECT area, i, j, false AS by_box FROM inside UNION ALL SELECT area, i, j, true FROM (SELECT area, min(x0) AS w, max(x0) AS e, min(y0) AS s, max(y0) AS n FROM sides WHERE area NOT IN (SELECT area FROM inside) GROUP BY area) JOIN centres ON lat BETWEEN s AND n AND lon BETWEEN w AND e)
"""


@query(WITH + SMALL + "SELECT * FROM in_cells")
def geo_area_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Centres of a grid of 0.1 degrees inside polygons by scan lines, those of the box where none is inside."""
    return PG.grid_cells(small_areas(spark, folder), "area")


@query(WITH + SMALL + """, cells AS (SELECT date_trunc('hour', ts) AS time, user_id % 20 AS i, user_id // 20 % 20 AS j, round(value, 2) AS value FROM events)
SELECT area, strftime(time, '%Y-%m-%d %H') AS hour, round(avg(273 + value / 100), 7) AS d2m, round(avg(value * 1000), 2) AS ssr FROM in_cells JOIN cells USING (i, j) GROUP BY 1, 2""")
def features_area_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly means of a reanalysis over the cells inside each polygon."""
    cells = PG.grid_cells(small_areas(spark, folder), "area")
    got = PG.area_cell_means(grid(spark, folder).select("time", "lat", "lon", "d2m", "ssr"), cells, "area")
    return got.select("area", F.date_format("time", "yyyy-MM-dd HH").alias("hour"), F.round("d2m", 7).alias("d2m"), F.round("ssr", 2).alias("ssr"))


# --- layers on grids of their own ---

GRIDS = """, grids AS (SELECT layer, -120 + (layer % 4) * 0.32 AS x0, 40 - (layer % 3) * 0.2 AS y0, 0.01 AS dx, -0.01 AS dy, n_rows, 128 AS n_cols FROM (SELECT DISTINCT layer FROM pixels), (SELECT max(row) + 1 AS n_rows FROM pixels)),
slc AS (SELECT layer, row, col, CAST(v AS DOUBLE) AS re, CAST((v * 7 + row) % 1000 AS DOUBLE) AS im FROM pixels WHERE (row + col + layer) % 5 <> 0)
"""


def grids(spark: SparkSession, folder: str):
    """Each label's pixels as a layer of its own grid, shifted by whole cells."""
    p = pixels(spark, folder)
    size = p.agg((F.max("row") + 1).alias("n_rows"))
    g = p.select("layer").distinct().crossJoin(size)
    k = F.col("layer")
    return g.select("layer", (-120 + k % 4 * 0.32).alias("x0"), (40 - k % 3 * 0.2).alias("y0"), F.lit(0.01).alias("dx"), F.lit(-0.01).alias("dy"), "n_rows", F.lit(128).cast("long").alias("n_cols"))


def complex_layers(spark: SparkSession, folder: str):
    """(layer, row, col, re, im), a fifth of the pixels missing."""
    p = pixels(spark, folder).where((F.col("row") + F.col("col") + F.col("layer")) % 5 != 0)
    return p.select("layer", "row", "col", F.col("v").cast("double").alias("re"), ((F.col("v") * 7 + F.col("row")) % 1000).cast("double").alias("im"))


@query(WITH + GRIDS + """, placed AS (SELECT layer, CAST(row + round((40 - y0) * 100) AS BIGINT) AS row, CAST(col + round((x0 + 120) * 100) AS BIGINT) AS col, re, im FROM slc JOIN grids USING (layer) WHERE re <> 0 OR im <> 0)
SELECT row - 10 AS row, col - 20 AS col, re, im, layer FROM placed WHERE row >= 10 AND col >= 20 AND col < 180 AND row < 210 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY layer) = 1""")
def pixel_complex_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid complex value over layers of shifted origins, clipped to an area."""
    return M.first_valid(complex_layers(spark, folder), grids(spark, folder), ["re", "im"], (-119.8, 37.9, -118.2, 39.9))


@query(WITH + GRIDS + "SELECT CAST(row + round((40 - y0) * 100) AS BIGINT) AS row, CAST(col + round((x0 + 120) * 100) AS BIGINT) AS col, v, layer FROM pixels JOIN grids USING (layer) WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY CAST(row + round((40 - y0) * 100) AS BIGINT), CAST(col + round((x0 + 120) * 100) AS BIGINT) ORDER BY layer) = 1")
def pixel_real_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid real value over layers of shifted origins."""
    return M.first_valid(pixels(spark, folder).select("layer", "row", "col", "v"), grids(spark, folder), ["v"])


CROPPED = """, met AS (SELECT layer, x0, y0, greatest(0, least(n_rows, floor(round((y0 - 39.635) * 100, 6)))) AS row0, greatest(0, least(n_rows, ceil(round((y0 - 38.995) * 100, 6)))) AS row1, greatest(0, least(n_cols, floor(round((-119.715 - x0) * 100, 6)))) AS col0, greatest(0, least(n_cols, ceil(round((-118.995 - x0) * 100, 6)))) AS col1 FROM grids),
win AS (SELECT * FROM met WHERE row0 < row1 AND col0 < col1)
"""
BOX = (-119.715 + 0.03, 38.995 + 0.03, -118.995 - 0.03, 39.635 - 0.03)


@query(WITH + GRIDS + CROPPED + "SELECT layer, CAST(row - row0 AS BIGINT) AS row, CAST(col - col0 AS BIGINT) AS col, v FROM pixels JOIN win USING (layer) WHERE row >= row0 AND row < row1 AND col >= col0 AND col < col1")
def pixel_crop_to_area(spark: SparkSession, folder: str) -> DataFrame:
    """Every layer cropped to an area with a buffer, on its own grid; layers that don't meet it are left out."""
    return M.crop(pixels(spark, folder).select("layer", "row", "col", "v"), grids(spark, folder), BOX, 0.03)


@query(WITH + GRIDS + CROPPED + """, one AS (SELECT max(round((x0 + 120) * 100) + col0) AS w, min(round((x0 + 120) * 100) + col1) AS e, max(round((40 - y0) * 100) + row0) AS n, min(round((40 - y0) * 100) + row1) AS s FROM win)
SELECT layer, count(*) AS n, CAST(min(row - (n - round((40 - y0) * 100))) AS BIGINT) AS first_row, CAST(sum(v) AS BIGINT) AS total FROM pixels JOIN win USING (layer), one
WHERE row >= n - round((40 - y0) * 100) AND row < s - round((40 - y0) * 100) AND col >= w - round((x0 + 120) * 100) AND col < e - round((x0 + 120) * 100) GROUP BY layer""")
def pixel_crop_to_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Layers cropped to what all that meet an area have in common of it."""
    got = M.crop(pixels(spark, folder).select("layer", "row", "col", "v"), grids(spark, folder), BOX, 0.03, common=True)
    return got.groupBy("layer").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.sum("v").alias("total"))


# --- coherence by class group ---

# Land-cover codes.
CODES = (10, 20, 30, 40, 50, 60, 80, 90, 95, 100)


@query(WITH + """, fine AS (SELECT row, col, ([10, 20, 30, 40, 50, 60, 80, 90, 95, 100])[CAST((row // 4 + col // 4 * 3 + CASE WHEN abs(v) % 4 = 0 THEN abs(v) ELSE 0 END) % 10 + 1 AS INT)] AS cls FROM pixels),
coarse AS (SELECT row // 4 AS row, col // 4 AS col, cls FROM fine GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY row // 4, col // 4 ORDER BY count(*) DESC, cls) = 1),
cells AS (SELECT season, lag, (part - 1) // 32 AS row, (part - 1) % 32 AS col, coh FROM samples WHERE coh > 0 AND coh < 255)
SELECT season, CASE WHEN cls IN (50, 60) THEN 'stable' WHEN cls IN (20, 30, 40) THEN 'vegetation' WHEN cls IN (10, 95) THEN 'forest' ELSE 'water' END AS "group", lag, round(avg(coh) / 100, 6) AS coh, count(*) AS n FROM cells JOIN coarse USING (row, col) WHERE cls <> 100 GROUP BY 1, 2, 3 HAVING count(*) >= 30""")
def coherence_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """Mean coherence by season, class group and lag, classes brought to coherence cells by majority."""
    k = F.floor(F.col("row") / 4) + F.floor(F.col("col") / 4) * 3 + F.when(F.abs("v") % 4 == 0, F.abs("v")).otherwise(0)
    fine = pixels(spark, folder).select("row", "col", F.element_at(F.array(*map(F.lit, CODES)), (k % 10 + 1).cast("int")).alias("cls"))
    cell = samples(spark, folder).select("season", "lag", F.floor((F.col("part") - 1) / 32).alias("row"), ((F.col("part") - 1) % 32).alias("col"), "coh")
    return K.levels_by_class(cell, X.majority(fine, 4)).select("season", "group", "lag", F.round("coh", 6).alias("coh"), "n")
