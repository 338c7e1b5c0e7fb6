"""Column functions over coordinates: ellipsoid, boxes, polygons in WKT, line of sight, grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 axes and first eccentricity squared.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
EARTH = 6371000.0


def ecef(lat: Column, lon: Column, height: Column) -> Column:
    """struct<x, y, z> in metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) ** 2)
    return F.struct(((n + height) * F.cos(la) * F.cos(lo)).alias("x"), ((n + height) * F.cos(la) * F.sin(lo)).alias("y"), ((n * (1 - E2) + height) * F.sin(la)).alias("z"))


def snapped(lo: Column, hi: Column, buffer: float, step: int) -> tuple[Column, Column]:
    """A range widened by ``buffer`` and then outward to multiples of ``step``."""
    return (F.floor((lo - buffer) / step) * step).cast("long"), (F.ceil((hi + buffer) / step) * step).cast("long")


def wkt_points(wkt: Column) -> Column:
    """array<struct<lon, lat>> of all listed vertices."""
    number = r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?)\s+(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"
    lon, lat = F.regexp_extract_all(wkt, F.lit(number), F.lit(1)), F.regexp_extract_all(wkt, F.lit(number), F.lit(2))
    return F.transform(F.arrays_zip(lon.alias("a"), lat.alias("b")), lambda p: F.struct(p["a"].cast("double").alias("lon"), p["b"].cast("double").alias("lat")))


def points_box(points: Column) -> Column:
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def points_mean(points: Column) -> Column:
    """Mean of all listed vertices; a closing vertex counts again."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def box_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners)), F.lit("))"))


def inside(points: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule: edges that a ray to the east crosses."""
    edges = F.arrays_zip(points.alias("a"), F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1)).alias("b"))
    crosses = F.filter(
        edges,
        lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
    )
    return F.pmod(F.size(crosses), F.lit(2)) == 1


def box_overlap(w1: Column, s1: Column, e1: Column, n1: Column, w2: Column, s2: Column, e2: Column, n2: Column) -> Column:
    """Share of the first box that the second covers, in planar degrees."""
    dx = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(w1, w2))
    dy = F.greatest(F.lit(0.0), F.least(n1, n2) - F.greatest(s1, s2))
    return dx * dy / ((e1 - w1) * (n1 - s1))


def los_up(east: Column, north: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - east * east - north * north)))


def vertical(value: Column, up: Column) -> Column:
    return F.when(up > 1e-6, value / up)


def phase_to_metres(phase: Column, wavelength: float = 0.05546576) -> Column:
    return phase * (-wavelength / (4 * math.pi))


def look_angle(near: Column, far: Column, height: Column) -> Column:
    """struct<range, incidence> at the scene's centre for a spherical earth; incidence in degrees."""
    r = (near + far) / 2
    orbit = EARTH + height
    look = F.acos((r * r + orbit * orbit - EARTH * EARTH) / (2 * r * orbit))
    return F.struct(r.alias("range"), F.degrees(F.asin(orbit / EARTH * F.sin(look))).alias("incidence"))


def pixel_index(value: Column, first: float, step: float, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround((value - first) / step, 0).cast("int")))


def epsg_of(epsg: Column, zone: Column, lat: Column, units: Column) -> Column:
    """EPSG as given, else from a UTM zone like 33N or a bare zone with the sign of lat, else 4326 for degrees."""
    number = F.regexp_extract(zone, r"^(\d{1,2})", 1).try_cast("int")
    south = F.upper(zone).endswith("S") | (~F.upper(zone).rlike("[NS]$") & (lat < 0))
    return F.coalesce(epsg.try_cast("int"), F.when(number.isNotNull(), F.when(south, 32700 + number).otherwise(32600 + number)), F.when(F.lower(units).startswith("deg"), 4326))


def margin_box(lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
    """A range with a margin of 5 % (100 if it is a point), whole and clamped to the frame; null if nothing is left."""
    m = F.when(hi > lo, (hi - lo) * 0.05).otherwise(100.0)
    first, last = F.greatest(F.lit(0), (lo - m).cast("long")), F.least(size.cast("long"), (hi + m).cast("long"))
    return F.when(last > first, first), F.when(last > first, last)


# Nominal slant range and azimuth posting in metres, and incidence in degrees, where a header lacks them.
SLANT_POSTING, AZIMUTH_POSTING, INCIDENCE = 2.33, 13.9, 39.0
LIGHT = 299792458.0


def ground_posting(sampling: Column, prf: Column, speed: Column, looks_range: Column, looks_azimuth: Column) -> Column:
    """struct<range, azimuth>: metres on the ground of a multilooked pixel, by the header's rates or the nominal ones."""
    slant = F.when(sampling != 0, LIGHT / (2 * sampling)).otherwise(SLANT_POSTING)
    azimuth = F.when((prf != 0) & (speed != 0), speed / prf).otherwise(AZIMUTH_POSTING)
    return F.struct((slant / math.sin(math.radians(INCIDENCE)) * looks_range).alias("range"), (azimuth * looks_azimuth).alias("azimuth"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def difference(a: Column, b: Column) -> Column:
    return F.struct(*((a[k] - b[k]).alias(k) for k in "xyz"))


def cross(a: Column, b: Column) -> Column:
    return F.struct(*((a[p] * b[q] - a[q] * b[p]).alias(k) for k, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))))


def of_length_one(a: Column) -> Column:
    return F.struct(*((a[k] / F.sqrt(dot(a, a))).alias(k) for k in "xyz"))


def clip_area(subject: list, clip: list) -> float:
    """Area of a polygon's part within a convex polygon, in planar units; vertices as (x, y)."""
    part, edge = np.asarray(subject, float).reshape(-1, 2), np.asarray(clip, float)
    area = lambda p: (p[:, 0] @ np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) @ p[:, 1]) / 2
    edge = edge if area(edge) > 0 else edge[::-1]
    for a, b in zip(edge, np.roll(edge, -1, axis=0)):
        # by each side of the convex polygon: vertices on its left stay, edges that cross it give a new vertex
        side = (b[0] - a[0]) * (part[:, 1] - a[1]) - (b[1] - a[1]) * (part[:, 0] - a[0])
        after, next_side = np.roll(part, -1, axis=0), np.roll(side, -1)
        crosses = side * next_side < 0
        share = np.divide(side, side - next_side, out=np.zeros(len(side)), where=crosses)
        both = np.stack([part, part + (after - part) * share[:, None]], axis=1).reshape(-1, 2)
        part = both[np.stack([side >= 0, crosses], axis=1).ravel()]
        if not len(part):
            return 0.0
    return float(abs(area(part)))


def coverage(aoi: list):
    """Pandas UDF: share of a convex area of interest that a footprint (array<struct<lon, lat>>) covers."""
    whole = clip_area(aoi, aoi)

    @F.pandas_udf("double")
    def share(footprints: pd.Series) -> pd.Series:
        return footprints.map(lambda f: None if f is None else clip_area([(p["lon"], p["lat"]) for p in f], aoi) / whole)

    return share
