"""Text, JSON and Parquet sources and sinks of the domain's documents and tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEATHER = "daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_sum: array<double>, snowfall_sum: array<double>, snow_depth_max: array<double>>, hourly struct<time: array<string>, temperature_2m: array<double>, soil_moisture_0_to_7cm: array<double>>"
NDVI = "subset array<struct<band: string, modis_date: string, calendar_date: string, data: array<int>>>"
NODATA = -9999.0
# Fixed value: the least valid vegetation count is above this fill value.
NDVI_FILL = -28672


def weather_days(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(site, day, t_max, t_min, rain, snowfall, snow_depth) from parallel daily arrays in JSON."""
    p = rows.select("site", F.from_json(payload, WEATHER).alias("p"))
    d = p.select("site", F.inline(F.arrays_zip("p.daily.time", "p.daily.temperature_2m_max", "p.daily.temperature_2m_min", "p.daily.precipitation_sum", "p.daily.snowfall_sum", "p.daily.snow_depth_max")))
    return d.toDF("site", "day", "t_max", "t_min", "rain", "snowfall", "snow_depth").withColumn("day", F.to_date("day"))


def weather_hour(rows: DataFrame, payload: str = "payload", default: int = 17) -> DataFrame:
    """(site, day, temp) at each site's hour (column hour, else the default) from hourly arrays in JSON."""
    p = rows.select("site", F.coalesce("hour", F.lit(default)).alias("want"), F.from_json(payload, WEATHER).alias("p"))
    h = p.select("site", "want", F.inline(F.arrays_zip("p.hourly.time", "p.hourly.temperature_2m"))).toDF("site", "want", "time", "temp")
    return h.where(F.substring("time", 12, 2).cast("int") == F.col("want")).select("site", F.to_date(F.substring("time", 1, 10)).alias("day"), "temp")


def ndvi_composites(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(site, code, ndvi): mean of the valid pixels of each composite, scaled, within 0 and 1."""
    s = rows.select("site", F.explode(F.from_json(payload, NDVI)["subset"]).alias("s"))
    valid = F.filter("s.data", lambda x: x > NDVI_FILL)
    mean = F.aggregate(valid, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(valid) * 0.0001
    return s.where(F.size(valid) > 0).select("site", F.col("s.modis_date").alias("code"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("ndvi"))


def coherence_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ref, sec, coh, bperp) of lines "date12 coh _ bperp ..." with at least five fields; # starts a comment."""
    f = F.split(F.trim(column), r"\s+")
    ok = lines.where(~F.trim(column).startswith("#") & (F.size(f) >= 5))
    day = F.split(F.get(f, F.lit(0)), "_")
    return ok.select(F.get(day, F.lit(0)).alias("ref"), F.get(day, F.lit(1)).alias("sec"), F.get(f, F.lit(1)).try_cast("double").alias("coh"), F.get(f, F.lit(3)).try_cast("double").alias("bperp"))


def key_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(file, one column a key): the first line "key = value" of each key in each file's (file, pos, value)."""
    kv = lines.select("file", "pos", F.trim(F.regexp_extract("value", r"^\s*([^=]+?)\s*=", 1)).alias("k"), F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1)).alias("v"))
    return kv.where(F.col("k").isin(keys)).groupBy("file").pivot("k", keys).agg(F.min_by("v", "pos"))


def slice_orbits(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """(slice, file): the listed orbit file if it exists, else <slice>.EOF, else any that carries the slice's date."""
    pair = lines.select(F.get(F.split("value", ":"), F.lit(0)).alias("slice"), F.get(F.split("value", ":"), F.lit(1)).alias("want"))
    pair = pair.withColumn("day", F.regexp_extract("slice", r"(\d{8})", 1)).withColumn("own", F.concat("slice", F.lit(".EOF")))
    by_day = listing.select(F.explode(F.regexp_extract_all("file", F.lit(r"(\d{8})"), F.lit(1))).alias("day"), "file").groupBy("day").agg(F.min("file").alias("by_day"))
    one = lambda c: listing.select(F.col("file").alias(c), F.col("file").alias(f"has_{c}"))
    out = pair.join(one("want"), "want", "left").join(one("own"), "own", "left").join(by_day, "day", "left")
    return out.select("slice", F.coalesce("has_want", "has_own", "by_day").alias("file"))


def numbers(lines: DataFrame, place: int = 3, column: str = "value") -> DataFrame:
    """(other columns, x): the finite numbers in the given place (from 1) of whitespace tables."""
    x = F.get(F.split(F.trim(column), r"\s+"), F.lit(place - 1)).try_cast("double")
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, x.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) != double('Infinity')")


def baseline_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a five-column baseline table; shorter rows are rejected; fewer than two dates is an error."""
    f = F.split(F.trim(column), r"\s+")
    rows = lines.where(F.size(f) >= 5).select(F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).try_cast("double").alias("t"), F.get(f, F.lit(2)).try_cast("double").alias("day"), F.get(f, F.lit(3)).try_cast("double").alias("along"), F.get(f, F.lit(4)).try_cast("double").alias("bperp"))
    n = rows.agg(F.countDistinct("day").alias("n"))
    return rows.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("n") >= 2, F.lit("a baseline table needs two dates")).isNull()).drop("n")  # one row


def archive_kind(name: Column) -> Column:
    """Kind of a product by its name's end."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for end, kind in (("unw_phase", "unwrapped"), ("corr", "coherence"), ("dem", "dem"), ("lv_theta", "incidence"), ("water_mask", "water"), ("wrapped_phase", "wrapped"), ("conncomp", "components")):
        out = F.when(low.rlike(rf"{end}(\.\w+)?$") & out.isNull(), kind).otherwise(out)
    return out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, kind) of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return files.withColumn("kind", archive_kind(F.col("path"))).dropDuplicates(["path"])


def archives(members: DataFrame) -> DataFrame:
    """(archive, n_members, kinds, west, south, east, north) of members (archive, path, west, south, east, north).

    Only rasters (.tif) count, each path once. The bounds are those of the archive's first raster by name. Kinds are
    sorted; a raster of no known kind adds none.
    """
    rasters = members.where(F.lower("path").endswith(".tif")).dropDuplicates(["archive", "path"]).withColumn("kind", archive_kind(F.col("path")))
    box = [F.min_by(c, "path").alias(c) for c in ("west", "south", "east", "north")]
    return rasters.groupBy("archive").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_set("kind")).alias("kinds"), *box)


def required_layers(files: DataFrame, needed: tuple[str, ...] = ("unwrapped", "coherence", "dem")) -> DataFrame:
    """(product, n per kind); a product without a needed kind is an error."""
    n = files.groupBy("product").agg(*(F.count(F.when(F.col("kind") == k, True)).alias(f"n_{k}") for k in needed))
    whole = F.lit(True)
    for k in needed:
        whole = whole & (F.col(f"n_{k}") > 0)
    return n.where(F.assert_true(whole, F.lit("a required layer is missing")).isNull())


#: Layers of a rate product that are bands of their own, products with a band a date, of one layer, and of masks.
RATES, RATE_LAYERS = ("velocity", "velocityERA5"), ("velocity", "velocityStd", "residue", "intercept", "interceptStd")
SERIES = ("timeseries", "timeseriesResidual")
SCALARS = ("avgSpatialCoh", "temporalCoherence", "demErr", "numInvIfgram")
MASKS = ("maskTempCoh", "maskConnComp")
#: The value of a mask's missing pixels.
MASK_NODATA = 255


def export_bands(product: DataFrame) -> DataFrame:
    """(file, band, is_mask, row, col, value) of a product (product, dataset, date, row, col, value, no_data or not).

    A product may be named with the prefix geo_. Rates are split into a file a layer (the product's own name for the layer
    named like it, else <product>_<layer>; other layers go); a series has a band a date; others one band named like the
    product. Missing and infinite values, and those equal to no_data, become NODATA, in masks MASK_NODATA; masks are whole
    numbers. An unknown product is an error.
    """
    name = F.regexp_replace("product", "^geo_", "")
    known = name.isin(*RATES, *SERIES, *SCALARS, *MASKS)
    checked = product.withColumn("_name", F.when(known, name).otherwise(F.raise_error(F.concat(F.lit("unknown product "), F.coalesce("product", F.lit("null")))).cast("string")))
    kept = checked.where(~F.col("_name").isin(*RATES) | F.col("dataset").isin(*RATE_LAYERS))
    rate, series, mask = (F.col("_name").isin(*x) for x in (RATES, SERIES, MASKS))
    file = F.when(rate & (F.col("dataset") != F.col("_name")), F.concat_ws("_", "product", "dataset")).otherwise(F.col("product"))
    band = F.when(series, F.col("date").cast("string")).when(rate, F.col("dataset")).otherwise(F.col("_name"))
    v = F.col("value").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    if "no_data" in product.columns:
        bad = bad | F.coalesce(v == F.col("no_data").cast("double"), F.lit(False))
    clean = F.when(bad, F.when(mask, float(MASK_NODATA)).otherwise(NODATA)).otherwise(F.when(mask, F.floor(v).cast("double")).otherwise(v))
    return kept.select(file.alias("file"), band.alias("band"), mask.alias("is_mask"), "row", "col", clean.alias("value"))


def write_bands(product: DataFrame, path: str) -> None:
    """The bands of products: values as float in path/values, masks as bytes (short, 0 to 255) in path/masks, a folder a file
    and band, sorted by row and column. Pixels of a band are spread over tasks by blocks of rows."""
    bands = export_bands(product)
    for part, own, kind in (("values", ~F.col("is_mask"), "float"), ("masks", F.col("is_mask"), "short")):
        rows = bands.where(own).select("file", "band", "row", "col", F.col("value").cast(kind).alias("value"))
        rows.repartition("file", "band", F.floor(F.col("row") / 1024)).sortWithinPartitions("file", "band", "row", "col").write.partitionBy("file", "band").parquet(f"{path}/{part}")


def read_bands(spark: SparkSession, path: str, file: str | None = None, band: str | None = None) -> DataFrame:
    """(file, band, row, col, value); of one file or band only its folders are read."""
    rows = spark.read.schema("row long, col long, value float, file string, band string").parquet(f"{path}/values")
    masks = spark.read.schema("row long, col long, value short, file string, band string").parquet(f"{path}/masks")
    both = rows.withColumn("value", F.col("value").cast("double")).unionByName(masks.withColumn("value", F.col("value").cast("double")))
    for c, x in (("file", file), ("band", band)):
        both = both if x is None else both.where(F.col(c) == x)
    return both.select("file", "band", "row", "col", "value")


def export_values(product: DataFrame) -> DataFrame:
    """(dataset, date, row, col, value): missing and infinite values become NODATA; masks 0, 1 or 255."""
    v = F.col("value").cast("double")
    plain = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), NODATA).otherwise(v)
    mask = F.when(v.isNull() | F.isnan(v), 255.0).otherwise((v != 0).cast("double"))
    known = F.col("dataset").isin("velocity", "velocityStd", "timeseries", "temporalCoherence", "maskTempCoh", "numInvIfgram", "demErr")
    checked = product.where(F.assert_true(known, F.lit("unknown product")).isNull())
    return checked.withColumn("value", F.when(F.col("dataset").startswith("mask"), mask).otherwise(plain))


def write_export(product: DataFrame, path: str) -> None:
    """Partitioned by dataset and date, sorted by row and column within a file."""
    export_values(product).repartition("dataset", "date").sortWithinPartitions("row", "col").write.partitionBy("dataset", "date").parquet(path)


def stack_documents(pairs: DataFrame) -> DataFrame:
    """(stack, document): one JSON document a stack, with sorted pairs, baselines and scenes."""
    p = F.array_sort(F.collect_set(F.array(F.col("ref").cast("string"), F.col("sec").cast("string"))))
    s = F.array_sort(F.array_distinct(F.concat(F.collect_set("ref"), F.collect_set("sec"))))
    return pairs.groupBy("stack").agg(p.alias("pairs"), s.alias("scenes")).select("stack", F.to_json(F.struct("pairs", "scenes")).alias("document"))


DOCUMENT = "pairs array<array<string>>, scenes array<string>, baselines map<string, double>"


def pairs_of_stacks(documents: DataFrame, legacy: DataFrame | None = None, flat: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """(stack, ref, sec), sorted out of JSON of several layouts, for each stack from the first that has it.

    explicit and legacy: (stack, text) with a list of pairs; documents: (stack, document); flat: (text), a list for
    all, which counts only if no stack has one of its own. Pairs are distinct.
    """
    lists = "array<array<string>>"
    sources = [x.select("stack", F.from_json(c, kind).alias("j")).select("stack", pairs.alias("p")) for x, c, kind, pairs in (
        (explicit, "text", lists, F.col("j")), (documents, "document", DOCUMENT, F.col("j.pairs")), (legacy, "text", lists, F.col("j"))) if x is not None]
    rows = None
    for i, one in enumerate(sources):
        one = one.where("p IS NOT NULL").withColumn("rank", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("stack").agg(F.min_by("p", "rank").alias("p"))
    if flat is not None and best.isEmpty():
        best = flat.select(F.lit(None).cast("string").alias("stack"), F.from_json("text", lists).alias("p"))
    return best.select("stack", F.explode("p").alias("p")).select("stack", F.get("p", F.lit(0)).alias("ref"), F.get("p", F.lit(1)).alias("sec")).distinct()


SCORES_VERSION = 2


def score_documents(scores: DataFrame, scenes: DataFrame, version: int = SCORES_VERSION) -> DataFrame:
    """(stack, document): the scores of each stack's pairs (stack, ref, sec, score) with version, counts and scene names."""
    each = scores.groupBy("stack").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "ref", "sec").alias("k"), F.col("score").cast("double").alias("v"))))).alias("scores"))
    names = scenes.groupBy("stack").agg(F.array_sort(F.collect_set(F.col("scene").cast("string"))).alias("names"))
    fields = F.struct(F.lit(version).alias("schema_version"), F.lit(True).alias("complete"), F.size("names").alias("n_scenes"), F.size("scores").alias("n_pairs"), F.col("names").alias("scene_names"), "scores")
    return names.join(each, "stack").select("stack", F.to_json(fields).alias("document"))


STORED = "schema_version int, complete boolean, n_scenes long, n_pairs long, scene_names array<string>, scores map<string, double>"


def stored_scores(documents: DataFrame, version: int = SCORES_VERSION) -> DataFrame:
    """(stack, n_scenes, n_pairs, complete, scene_names, scores) of score documents of the version; others count as absent."""
    d = documents.select("stack", F.from_json("document", STORED).alias("d")).where(F.col("d.schema_version") == version)
    return d.select("stack", *(F.col(f"d.{c}").alias(c) for c in ("n_scenes", "n_pairs", "complete", "scene_names", "scores")))


def to_rebuild(stored: DataFrame, scenes: DataFrame) -> DataFrame:
    """(stack, rebuild): whether a stack of scenes has none that is complete and holds all its scenes (or, without names, as many)."""
    now = scenes.groupBy("stack").agg(F.collect_set(F.col("scene").cast("string")).alias("now"))
    held = F.when(F.col("scene_names").isNotNull(), F.size(F.array_except("now", "scene_names")) == 0).otherwise(F.col("n_scenes") >= F.size("now"))
    return now.join(stored, "stack", "left").select("stack", (~F.coalesce(F.col("complete") & held, F.lit(False))).alias("rebuild"))


def write_reanalysis(grid: DataFrame, path: str) -> None:
    """Cells (time, lat, lon, variables) by year and month, so that a reader of few dates touches few folders.

    A month is dealt out by ranges of time and place, so that none is sorted in one task.
    """
    parts = grid.withColumns({"year": F.year("time"), "month": F.month("time")})
    parts.repartitionByRange("year", "month", "time", "lat", "lon").sortWithinPartitions("time", "lat", "lon").write.partitionBy("year", "month").parquet(path)


def read_reanalysis(spark: SparkSession, path: str, dates: DataFrame) -> DataFrame:
    """The cells of the months of the dates (day); only those folders are read."""
    months = dates.where("day IS NOT NULL").select(F.year("day").alias("y"), F.month("day").alias("m")).distinct().collect()  # twelve a year
    wanted = reduce(or_, ((F.col("year") == r["y"]) & (F.col("month") == r["m"]) for r in months), F.lit(False))
    return spark.read.parquet(path).where(wanted)


def write_decay_maps(maps: DataFrame, path: str) -> None:
    """Maps (season, pol, row, col, g_inf, g0, tau) in folders of season and polarization, sorted by row and column.

    Invalid values become NODATA. Rows are spread over tasks in blocks, so that a file's row groups hold few rows of the map.
    """
    bad = lambda c: F.when(F.col(c).isNull() | F.isnan(c), NODATA).otherwise(F.col(c)).alias(c)
    slim = maps.select("season", "pol", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(bad(c) for c in ("g_inf", "g0", "tau")))
    slim.repartition("season", "pol", F.floor(F.col("row") / 1024)).sortWithinPartitions("season", "pol", "row", "col").write.partitionBy("season", "pol").parquet(path)


def read_decay_maps(spark: SparkSession, path: str, seasons: list[str] | None = None, pol: str | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """With valid; what is not reads as 0, 0, 30. Of given seasons, a polarization and a box (rows, columns, ends included)
    only those folders and row groups are read."""
    m = spark.read.parquet(path)
    if seasons is not None:
        m = m.where(F.col("season").isin(seasons))
    if pol is not None:
        m = m.where(F.col("pol") == pol)
    if box is not None:
        m = m.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3]))
    ok = (F.col("g_inf") != NODATA) & (F.col("g0") != NODATA) & (F.col("tau") != NODATA)
    return m.select("season", "pol", "row", "col", *(F.when(ok, F.col(c)).otherwise(d).alias(c) for c, d in (("g_inf", 0.0), ("g0", 0.0), ("tau", 30.0))), ok.alias("valid"))
