"""Per-date features: trailing sums, nearest and ranked joins, cascades, bad dates, stored features with an age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_sums(days: DataFrame, value: str = "precip", spans=(3, 7)) -> DataFrame:
    """Sums over the last n calendar days, nulls skipped, all null: null."""
    w = Window.partitionBy("site").orderBy("t")
    return days.select("*", *(F.sum(value).over(w.rangeBetween(1 - n, 0)).alias(f"{value}_{n}day") for n in spans))


def bad_days(days: DataFrame, snow: float = 0.5, rain: float = 25.0) -> DataFrame:
    """Wet snow, much snow, or much rain (three-day sum, else the day's): acquisitions to leave out."""
    wet = (F.col("temp") > 0) & (F.col("snow") > 0.30)
    return days.where(F.coalesce(wet, F.lit(False)) | F.coalesce(F.col("snow") >= snow, F.lit(False)) | F.coalesce(F.coalesce("precip_3day", "precip") >= rain, F.lit(False)))


def day_pairs(days: DataFrame, most: int) -> DataFrame:
    """(site, t_d1, t_d2, dt, and the features of both days with _d1 and _d2): days up to ``most`` apart."""
    cols = [c for c in days.columns if c not in ("site", "t")]
    side = lambda d: days.select("site", F.col("t").alias(f"t_{d}"), *(F.col(c).alias(f"{c}_{d}") for c in cols))
    first = side("d1").withColumn("t_d2", F.explode(F.sequence(F.col("t_d1") + 1, F.col("t_d1") + most)))
    return first.join(side("d2"), ["site", "t_d2"]).withColumn("dt", F.col("t_d2") - F.col("t_d1"))


def nearest(left: DataFrame, right: DataFrame, key: str, span: int) -> DataFrame:
    """Each row of left (key, t) with the nearest row of right (key, at, ...) within ``span``; ties: the earlier.

    Both meet in buckets of ``span``, so that a row sees its neighbourhood and not all of its key.
    """
    own = lambda c: F.floor(F.col(c) / span)
    a = left.withColumn("_b", own("t"))
    b = right.withColumn("_b", F.explode(F.array(own("at") - 1, own("at"), own("at") + 1)))
    gap = F.abs(F.col("at") - F.col("t"))
    columns = [c for c in right.columns if c != key]
    best = a.join(b, [key, "_b"]).where(gap <= span).groupBy(key, "t").agg(F.min_by(F.struct(*columns), F.struct(gap, "at")).alias("_r"))
    return left.join(best, [key, "t"], "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def best_in_window(left: DataFrame, right: DataFrame, key: str, span: int, cap: float, rank: list[Column]) -> DataFrame:
    """Each row of left (key, t) with the best row of right within ``span`` and under the cap of ``cloud``."""
    own = lambda c: F.floor(F.col(c) / span)
    a = left.withColumn("_b", own("t"))
    b = right.where(F.col("cloud") <= cap).withColumn("_b", F.explode(F.array(own("at") - 1, own("at"), own("at") + 1)))
    found = a.join(b, [key, "_b"]).where(F.abs(F.col("at") - F.col("t")) <= span)
    return found.groupBy(key, "t").agg(F.min_by(F.struct("at", "cloud", "value"), F.struct(*rank)).alias("_r")).select(key, "t", "_r.*")


def interval_first(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Each point (id, key, t) with the first interval (file, v0, v1) of its key that holds it, ends included."""
    days = intervals.withColumn("t", F.explode(F.sequence("v0", "v1")))
    return points.join(days, [key, "t"]).groupBy("id", key, "t").agg(F.min("file").alias("file"))


def fresh(store: DataFrame, wanted: DataFrame, now: int, ttl: dict[str, int], refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of (section, key, value, fetched) still valid, wanted keys to fetch); latest fetch wins."""
    last = store.groupBy("section", "key").agg(F.max_by(F.struct("value", "fetched"), "fetched").alias("_r")).select("section", "key", "_r.*")
    limit = F.lit(None).cast("int")
    for s, d in ttl.items():
        limit = F.when(F.col("section") == s, d).otherwise(limit)
    keep = F.lit(not refresh) & (limit.isNull() | (F.lit(now) - F.col("fetched") <= limit))
    valid = last.where(keep).join(wanted, ["section", "key"], "left_semi")
    return valid, wanted.join(valid, ["section", "key"], "left_anti")


def lagrange(targets: DataFrame, vectors: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Each target (key, t) with the value interpolated through the ``k`` vectors (key, at, value) around it.

    The window starts k / 2 before the first later vector and is moved inside the series at its ends.
    """
    # one sort of a key's targets and vectors together counts the vectors before each
    targets = targets.select(key, F.col("t").cast("double").alias("t")).distinct()
    both = targets.select(key, F.col("t").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("v")).unionByName(vectors.select(key, F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value"), F.lit(1).alias("v")))
    w = Window.partitionBy(key).orderBy("at", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("i", F.sum("v").over(w))
    count = vectors.groupBy(key).agg(F.count("*").alias("n"))
    lo = F.greatest(F.lit(0), F.least(F.col("i") - k // 2, F.col("n") - k))
    wanted = placed.where("v = 0").join(count, key).select(key, F.col("at").alias("t"), F.explode(F.sequence(lo, F.least(lo + k, F.col("n")) - 1)).alias("rn"))
    near = wanted.join(placed.where("v = 1").select(key, (F.col("i") - 1).alias("rn"), "at", "value"), [key, "rn"])
    points = near.groupBy(key, "t").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    weight = lambda x: F.aggregate("p", F.lit(1.0), lambda acc, y: F.when(y["at"] == x["at"], acc).otherwise(acc * (F.col("t") - y["at"]) / (x["at"] - y["at"])))
    value = F.aggregate(F.transform("p", lambda x: weight(x) * x["value"]), F.lit(0.0), lambda acc, x: acc + x)
    return points.select(key, "t", F.size("p").cast("long").alias("n_used"), value.alias("value"))


FLUXES = ("ssr", "str", "smlt")


def area_means(grid: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """(time, one column a variable): means over the cells (time, lat, lon, variables) of an area, nulls left out."""
    values = [c for c in grid.columns if c not in ("time", "lat", "lon", "year", "month")]
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return grid.where(inside).groupBy("time").agg(*(F.avg(c).alias(c) for c in values))


def reanalysis_days(means: DataFrame, wanted: DataFrame, default: int = 17) -> DataFrame:
    """Per wanted (day, hour): the variables at that hour, and the day's sums of radiation and melt.

    means: area_means(). A day without the hour takes the nearest that it has (ties: the earlier). Temperatures are in
    degrees; net radiation is the sum of both balances, null if one is missing all day.
    """
    hours = means.withColumn("day", F.to_date("time")).withColumn("at", F.hour("time"))
    sums = hours.groupBy("day").agg(*(F.sum(c).alias(c) for c in FLUXES))
    want = wanted.select("day", F.coalesce("hour", F.lit(default)).alias("hour"))
    gap = F.abs(F.col("at") - F.col("hour"))
    near = want.join(hours, "day").groupBy("day", "hour").agg(F.min_by(F.struct("d2m", "skt", "u10", "v10", "swvl2", "swvl3", "lai_hv", "lai_lv"), F.struct(gap, "at")).alias("p"))
    speed = F.when((F.col("p.u10") != 0) & (F.col("p.v10") != 0), F.sqrt(F.col("p.u10") ** 2 + F.col("p.v10") ** 2))
    return want.join(near, ["day", "hour"], "left").join(sums, "day", "left").select(
        "day", "hour",
        F.round(F.col("p.d2m") - 273.15, 2).alias("dewpoint"), F.round(F.col("p.skt") - 273.15, 2).alias("skin_temp"), F.round(speed, 3).alias("wind_speed"),
        *(F.round(f"p.{c}", 4).alias(n) for c, n in (("swvl2", "soil_moisture_7_28"), ("swvl3", "soil_moisture_28_100"), ("lai_hv", "lai_high_veg"), ("lai_lv", "lai_low_veg"))),
        F.round(F.col("ssr") + F.col("str"), 2).alias("net_radiation"), F.round("smlt", 4).alias("snowmelt"),
    )


# Snow pixels from VALID_SNOW on are fill, from SNOW_COVERED on snow, PERMANENT_ICE is glacier.
VALID_SNOW, SNOW_COVERED, PERMANENT_ICE = 200, 40, 254


def snow_fractions(pixels: DataFrame, key: str, column: str = "v") -> DataFrame:
    """Share of snow among valid pixels, and of glacier among all; keys without a valid pixel are left out."""
    v = F.col(column)
    count = lambda c: F.count(F.when(c, True))
    n = pixels.groupBy(key).agg(F.count("*").alias("n"), count(v < VALID_SNOW).alias("valid"), count((v < VALID_SNOW) & (v >= SNOW_COVERED)).alias("snow"), count(v == PERMANENT_ICE).alias("ice"))
    return n.where("valid > 0").select(key, F.round(F.col("snow") / F.col("valid"), 4).alias("snow_cover_frac"), F.round(F.col("ice") / F.col("n"), 4).alias("glacier_fraction"))


#: Days of a fire's window: from so many before an acquisition to as many after.
FIRE_DAYS = 3


def fire_days(hotspots: DataFrame, areas: DataFrame) -> DataFrame:
    """(site, t): days within FIRE_DAYS of a hotspot (lat, lon, t) in the site's box (site, west, south, east, north).

    Hotspots meet areas in cells of one degree that a box touches, not all areas.
    """
    cells = lambda lo, hi: F.sequence(F.floor(lo), F.floor(hi))
    boxes = areas.withColumn("x", F.explode(cells("west", "east"))).withColumn("y", F.explode(cells("south", "north")))
    spots = hotspots.select("lat", "lon", "t", F.floor("lon").alias("x"), F.floor("lat").alias("y"))
    hit = spots.join(boxes, ["x", "y"]).where("lon BETWEEN west AND east AND lat BETWEEN south AND north").select("site", "t").distinct()
    return hit.select("site", F.explode(F.sequence(F.col("t") - FIRE_DAYS, F.col("t") + FIRE_DAYS)).alias("t")).distinct()


def with_fire(pairs: DataFrame, days: DataFrame) -> DataFrame:
    """pairs (site, t_d1, t_d2, ...) with fire: whether either day is one of fire_days()."""
    out = pairs.drop("fire")
    for d in ("d1", "d2"):
        out = out.join(days.select("site", F.col("t").alias(f"t_{d}"), F.lit(True).alias(f"_{d}")), ["site", f"t_{d}"], "left")
    return out.withColumn("fire", F.coalesce("_d1", "_d2", F.lit(False))).drop("_d1", "_d2")


def vegetation(days: DataFrame, optical: DataFrame, composites: DataFrame, climatology: Column, span: int = 16) -> DataFrame:
    """(site, t, ndvi, source) of days (site, t, ...): the optical value of the day, else the nearest composite, else climatology.

    optical: (site, t, value), composites: (site, at, value), climatology: a column of days.
    """
    out = days.withColumn("_c", climatology).join(optical.withColumnRenamed("value", "_o"), ["site", "t"], "left")
    near = nearest(out.select("site", "t"), composites, "site", span).select("site", "t", F.col("value").alias("_m"))
    out = out.join(near, ["site", "t"])
    source = F.when(F.col("_o").isNotNull(), "sentinel2").when(F.col("_m").isNotNull(), "modis").otherwise("climatology")
    return out.select("site", "t", F.coalesce("_o", "_m", "_c").alias("ndvi"), source.alias("source"))


def dominant_source(rows: DataFrame, key: str) -> DataFrame:
    """(key, ndvi_source, cached): one source as it is; of several sentinel2 if it is among them, else mixed with modis.

    cached: none of the key's rows was fetched anew (column fetched).
    """
    s = rows.groupBy(key).agg(F.collect_set("source").alias("s"), F.coalesce(~F.bool_or("fetched"), F.lit(True)).alias("cached"))
    several = F.when(F.array_contains("s", "sentinel2"), "sentinel2").when(F.array_contains("s", "modis"), "mixed").otherwise("climatology")
    return s.select(key, F.when(F.size("s") > 1, several).otherwise(F.coalesce(F.get("s", F.lit(0)), F.lit("climatology"))).alias("ndvi_source"), "cached")
