"""Registered queries: the scene catalogue. Each names the inventory rows it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..operators import catalog as C
from .adapters import scenes, table
from .registry import query


@query("SELECT stack, path, frame, scene, CAST(day AS VARCHAR) AS day, orbit FROM scenes WHERE day BETWEEN DATE '1996-03-01' AND DATE '1999-10-31' AND path IN (1, 3, 5, 7, 9, 11) AND month(day) IN (3, 4, 5, 9, 10) AND orbit IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)")
def catalog_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Bound predicates that reach the scan; nothing found is an error."""
    got = C.search(scenes(spark, folder), start="1996-03-01", end="1999-10-31", paths=[1, 3, 5, 7, 9, 11], months=[3, 4, 5, 9, 10], orbits=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    return got.select("stack", "path", "frame", "scene", F.col("day").cast("string").alias("day"), "orbit")


@query("SELECT scene, stack, polarization FROM scenes WHERE (path = 2 AND frame = 'BUILDING' OR path = 4 AND frame = 'MACHINERY' OR path = 6) AND list_has_any(string_split(polarization, '-'), ['1', 'URGENT', '2']) AND path <> 6")
def catalog_stack_and_polarization(spark: SparkSession, folder: str) -> DataFrame:
    """Stack keys and polarization tokens."""
    s = scenes(spark, folder).withColumn("polarization", F.translate("polarization", "-", "+"))
    return C.filter_scenes(s, stacks=[(2, "BUILDING"), (4, "MACHINERY")], polarizations=["1", "URGENT", "2"]).select("scene", "stack", F.translate("polarization", "+", "-").alias("polarization"))


@query("SELECT s.scene, s.stack, s.direction FROM scenes s JOIN (SELECT stack FROM scenes QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t, scene) = 1 AND direction = 'ASCENDING') f USING (stack)")
def catalog_first_item_filter(spark: SparkSession, folder: str) -> DataFrame:
    """the first item of a stack decides for all of it."""
    return C.by_first_item(scenes(spark, folder), "direction", "ascending").select("scene", "stack", "direction")


@query("SELECT stack, CAST(day AS VARCHAR) AS day, scene, CAST(n - 1 AS BIGINT) AS n_dropped FROM (SELECT *, count(*) OVER (PARTITION BY stack, day) AS n FROM scenes) QUALIFY row_number() OVER (PARTITION BY stack, day ORDER BY t, scene) = 1")
def catalog_collapse_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """One scene per date, and how many were dropped."""
    s = scenes(spark, folder)
    n = s.groupBy("stack", "day").agg((F.count("*") - 1).alias("n_dropped"))
    return C.collapse_by_date(s).join(n, ["stack", "day"]).select("stack", F.col("day").cast("string").alias("day"), "scene", "n_dropped")


@query("SELECT path, frame, direction, count(*) AS n_scenes, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, array_to_string(list_sort(list_distinct(list(platform))), ',') AS platforms FROM scenes GROUP BY path, frame, direction")
def catalog_stack_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A1 A3 T5: scenes, dates and platforms of each stack, in order of path, then frame."""
    return C.stack_summary(scenes(spark, folder)).orderBy("path", "frame", "direction")


@query("SELECT path, count(*) AS n_scenes, 'merged_' || array_to_string(list_transform(list_sort(list_distinct(list(frame))), lambda x: 'f' || x), '_') AS tag, CAST(count(DISTINCT day) AS BIGINT) AS n_days FROM scenes GROUP BY path")
def catalog_merged_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """All frames of a track as one stack, one scene per day."""
    return scenes(spark, folder).groupBy("path").agg(F.count("*").alias("n_scenes"), N.merge_tag(F.collect_set("frame")).alias("tag"), F.countDistinct("day").alias("n_days"))


@query("SELECT CASE WHEN count(DISTINCT path) OVER (PARTITION BY day) > 1 THEN strftime(day, '%Y%m%d') || '_p' || path ELSE strftime(day, '%Y%m%d') END AS date_group, n FROM (SELECT day, path, count(*) AS n FROM scenes GROUP BY day, path)")
def catalog_date_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A4: bursts by date; by date and path where a date has several paths."""
    by = scenes(spark, folder).groupBy("day", "path").agg(F.count("*").alias("n"))
    paths = F.count("*").over(Window.partitionBy("day"))
    date = F.date_format("day", "yyyyMMdd")
    return by.select(F.when(paths > 1, F.concat(date, F.lit("_p"), F.col("path"))).otherwise(date).alias("date_group"), "n")


@query("SELECT path, day, n_have, array_to_string(list_sort(list_filter(every, lambda x: NOT list_contains(have, x))), ',') AS missing FROM (SELECT path, CAST(day AS VARCHAR) AS day, list_distinct(list(frame)) AS have, CAST(count(DISTINCT frame) AS BIGINT) AS n_have FROM scenes GROUP BY 1, 2) JOIN (SELECT path, list_distinct(list(frame)) AS every FROM scenes GROUP BY path) USING (path)")
def catalog_burst_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """A5: positions that a date lacks and others have."""
    return C.burst_consistency(scenes(spark, folder).withColumn("day", F.col("day").cast("string")), "path", "day", "frame")


@query("SELECT stack, scene, t FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY t, scene) AS n, count(*) OVER (PARTITION BY stack) AS c FROM scenes) WHERE n <= 5 AND least(c, 5) >= 5")
def catalog_first_of_stack(spark: SparkSession, folder: str) -> DataFrame:
    """The first five of each stack that has five."""
    return C.limit_per_stack(scenes(spark, folder), first=5, min_count=5).select("stack", "scene", "t")


@query("SELECT stack, scene, t FROM scenes QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t DESC, scene DESC) <= 3")
def catalog_last_of_stack(spark: SparkSession, folder: str) -> DataFrame:
    """The last three of each stack."""
    return C.limit_per_stack(scenes(spark, folder), last=3).select("stack", "scene", "t")


@query("SELECT name, min(scene) AS scene FROM scenes WHERE level <> 'F' AND scene % 7 = 0 GROUP BY name")
def catalog_search_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Look names up, first wins; every seventh order names itself with an extension."""
    s = scenes(spark, folder)
    names = s.where("scene % 7 = 0").select(F.concat("name", F.lit(".zip")).alias("name"))
    return C.search_by_name(s.withColumn("level", F.when(F.col("level") == "F", "METADATA_SLC").otherwise(F.col("level"))), names)[0]


@query("SELECT DISTINCT name FROM scenes s WHERE scene % 7 = 0 AND NOT EXISTS (SELECT 1 FROM scenes r WHERE r.name = s.name AND r.level <> 'F')")
def catalog_names_not_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names that the catalogue lacks."""
    s = scenes(spark, folder)
    names = s.where("scene % 7 = 0").select(F.concat("name", F.lit(".SAFE")).alias("name"))
    return C.search_by_name(s.withColumn("level", F.when(F.col("level") == "F", "METADATA_SLC").otherwise(F.col("level"))), names)[1]


@query("SELECT name, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS name FROM (SELECT doc_id, string_split_regex(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), chr(10)), '[\\s,]+') AS l FROM documents)) WHERE regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_\\-]{19,}') GROUP BY name")
def catalog_name_list(spark: SparkSession, folder: str) -> DataFrame:
    """S3: names of at least 20 characters in free text outside comments, first place of each."""
    return C.name_list(table(spark, folder, "documents"))


@query("""SELECT scene, regexp_extract(name, '_(\\d{8})T', 1) AS day_text, CAST(regexp_extract(name, '\\d{8}T(\\d{2})', 1) AS INT) AS hour, regexp_extract(name, '(\\d{8}T\\d{6})', 1) AS stamp,
CASE WHEN contains(platform, '1A') THEN 'S1A' WHEN contains(platform, '1B') THEN 'S1B' WHEN contains(platform, '1C') THEN 'S1C' ELSE 'S1D' END AS mission, strftime(day, '%Y%m%d') AS normal, strftime(day, 'A%Y%j') AS code, CAST(day AS VARCHAR) AS decoded,
strftime(day, '%Y') || lpad(CAST(dayofyear(day) - 1 AS VARCHAR), 3, '0') AS offset_id, CAST((scene % 24 + CASE WHEN (scene % 60) * 60 + scene % 60 > 1800 THEN 1 ELSE 0 END) % 24 AS INT) AS hour_rounded FROM scenes""")
def catalog_names_and_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates, hours and codes of names."""
    s = scenes(spark, folder)
    two = lambda n: F.lpad(F.pmod("scene", F.lit(n)).cast("string"), 2, "0")
    return s.select(
        "scene",
        N.scene_date(F.col("name")).alias("day_text"),
        N.scene_hour(F.col("name")).alias("hour"),
        N.start_stamp(F.col("name")).alias("stamp"),
        N.mission(F.col("platform")).alias("mission"),
        N.normal_date(F.col("day").cast("string")).alias("normal"),
        N.composite_code(F.col("day")).alias("code"),
        N.composite_day(N.composite_code(F.col("day"))).cast("string").alias("decoded"),
        N.day_offset_id(F.col("day")).alias("offset_id"),
        N.round_hour(F.concat(two(24), two(60), two(60))).alias("hour_rounded"),
    )


@query("""SELECT scene, 'IW' || (scene % 3 + 1) AS swath, CAST(118000 + scene % 1000 AS VARCHAR) || '_IW' || (scene % 3 + 1) AS position, lpad(CAST(orbit AS VARCHAR), 3, '0') || '_' || (118000 + scene % 1000) || '_IW' || (scene % 3 + 1) AS burst,
coalesce(CASE WHEN scene % 3 = 0 THEN path END, CASE WHEN scene % 3 = 1 THEN orbit END, orbit) AS track FROM scenes""")
def catalog_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Burst names, positions, ids and track numbers with their fallbacks."""
    b = scenes(spark, folder).select("*", F.concat(F.lit("S1_"), 118000 + F.pmod("scene", F.lit(1000)), F.lit("_IW"), F.pmod("scene", F.lit(3)) + 1, F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit("T131002_VV_A124-BURST")).alias("burst_name"))
    name = F.col("burst_name")
    burst = N.full_burst_id(F.col("orbit"), F.regexp_extract(name, r"^S1_(\d+)_", 1), N.swath_of(name))
    third = F.pmod("scene", F.lit(3))
    track = N.path_of(F.when(third == 0, F.col("path")), F.when(third == 1, F.col("orbit")), burst)
    return b.select("scene", N.swath_of(name).alias("swath"), N.burst_position(name).alias("position"), burst.alias("burst"), track.alias("track"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([^/]*)$', 1) AS product FROM pages")
def catalog_product_of_url(spark: SparkSession, folder: str) -> DataFrame:
    """The product id in a url."""
    return table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"/([^/]*)$", 1).alias("product"))


@query("SELECT stack, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) || 'T23:59:59' AS last_day, CAST(count(DISTINCT path) AS BIGINT) AS n_paths FROM scenes GROUP BY stack")
def catalog_search_span(spark: SparkSession, folder: str) -> DataFrame:
    """The span of a merged search; a span must have one path."""
    got = scenes(spark, folder).groupBy("stack").agg(F.min("day").cast("string").alias("first_day"), N.end_of_day(F.max("day").cast("string")).alias("last_day"), F.countDistinct("path").alias("n_paths"))
    return got.where(F.assert_true(F.col("n_paths") == 1).isNull())


@query("SELECT frame, CAST(day AS VARCHAR) AS day FROM (SELECT frame, day, count(DISTINCT direction) AS h FROM scenes GROUP BY frame, day) JOIN (SELECT frame, count(DISTINCT direction) AS n FROM scenes GROUP BY frame) USING (frame) WHERE h = n")
def catalog_dates_in_common(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of a frame that all its directions have."""
    return C.in_common(scenes(spark, folder).withColumn("day", F.col("day").cast("string")), "frame", "direction", "day")


@query("SELECT frame, direction, CAST(day AS VARCHAR) AS day FROM (SELECT DISTINCT frame, direction, day FROM scenes) a WHERE NOT EXISTS (SELECT 1 FROM scenes b WHERE b.frame = a.frame AND b.day = a.day AND b.direction <> a.direction)")
def catalog_dates_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """The dates that one direction has alone."""
    s = scenes(spark, folder).withColumn("day", F.col("day").cast("string"))
    return s.select("frame", "direction", "day").distinct().join(C.in_common(s, "frame", "direction", "day"), ["frame", "day"], "left_anti").select("frame", "direction", "day")


@query("SELECT path, arg_max(frame, (n, frame)) AS frame, max(n) AS n_days FROM (SELECT path, frame, count(DISTINCT day) AS n FROM scenes GROUP BY path, frame) GROUP BY path")
def catalog_best_covered(spark: SparkSession, folder: str) -> DataFrame:
    """The frame of each path with the most dates."""
    n = scenes(spark, folder).groupBy("path", "frame").agg(F.countDistinct("day").alias("n"))
    return n.groupBy("path").agg(F.max_by("frame", F.struct("n", "frame")).alias("frame"), F.max("n").alias("n_days"))


@query("SELECT c_custkey, to_json({type: 'Feature', id: c_custkey, burst: coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment)}) AS feature FROM customer")
def catalog_geojson(spark: SparkSession, folder: str) -> DataFrame:
    """Features as GeoJSON, nested ids lifted only where the outer one is absent."""
    c = table(spark, folder, "customer")
    burst = F.coalesce(F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_name")), F.col("c_mktsegment"))
    return c.select("c_custkey", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").alias("id"), burst.alias("burst"))).alias("feature"))
