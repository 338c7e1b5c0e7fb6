"""Registered queries: documents read as JSON, tables and lists; progress and completeness of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..sources import tables as S
from .adapters import collapsed, scenes, site_days, table
from .network import with_pairs
from .registry import query


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def source_json_props(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON column by a given schema."""
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT site, CAST(day AS VARCHAR) AS day, CAST(n AS DOUBLE) AS rain, round(snow, 6) AS snowfall FROM site_days")
def source_weather_days(spark: SparkSession, folder: str) -> DataFrame:
    """Parallel arrays of a site's payload, written as JSON and read back as days."""
    d = site_days(spark, folder)
    zero = F.array_repeat(F.lit(0.0), F.size("rows"))
    take = lambda k: F.transform("rows", lambda r: r[k])
    rows = d.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), F.col("n").cast("double").alias("n"), F.round("snow", 6).alias("snow")))).alias("rows"))
    daily = F.struct(take("day").alias("time"), zero.alias("temperature_2m_max"), zero.alias("temperature_2m_min"), take("n").alias("precipitation_sum"), take("snow").alias("snowfall_sum"), zero.alias("snow_depth_max"))
    payload = rows.select("site", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))
    return S.weather_days(payload).select("site", F.col("day").cast("string").alias("day"), "rain", "snowfall")


@query("SELECT site, strftime(day, 'A%Y%j') AS code, CASE WHEN n > 1 THEN round(least(1.0::DOUBLE, n * 0.01::DOUBLE), 6) END AS ndvi FROM site_days WHERE n > 1")
def source_ndvi_composites(spark: SparkSession, folder: str) -> DataFrame:
    """Composites from JSON subsets, fill values left out."""
    d = site_days(spark, folder)
    data = F.when(F.col("n") > 1, F.array(F.col("n") * 100, F.lit(-28672), F.col("n") * 100)).otherwise(F.array(F.lit(-28672).cast("long")))
    one = F.struct(F.lit("NDVI").alias("band"), F.concat(F.lit("A"), F.date_format("day", "yyyyDDD")).alias("modis_date"), data.alias("data"))
    payload = d.select("site", F.to_json(F.struct(F.array(one).alias("subset"))).alias("payload"))
    return S.ndvi_composites(payload).select("site", "code", F.round("ndvi", 6).alias("ndvi"))


@query(with_pairs("SELECT strftime(DATE '1970-01-01' + CAST(t_ref AS INT), '%Y%m%d') AS ref, strftime(DATE '1970-01-01' + CAST(t_sec AS INT), '%Y%m%d') AS sec, CAST(dt_days AS DOUBLE) AS coh, round(bperp, 2) AS bperp FROM usable WHERE ref % 5 <> 0"))
def source_coherence_table(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a coherence table, comments and short lines left out."""
    p = P.primary_pairs(collapsed(spark, folder))
    day = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")), "yyyyMMdd")
    line = F.concat_ws(" ", F.concat_ws("_", day("t_ref"), day("t_sec")), "dt_days", F.lit("0"), F.round("bperp", 2), F.lit("end"))
    lines = p.select(F.when(F.pmod("ref", F.lit(5)) == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return S.coherence_table(lines)


@query("SELECT file, WIDTH, LENGTH FROM (SELECT CAST(c_custkey AS VARCHAR) || '.rsc' AS file, CAST(c_nationkey * 100 AS VARCHAR) AS WIDTH, c_mktsegment AS LENGTH FROM customer)")
def source_key_values(spark: SparkSession, folder: str) -> DataFrame:
    """key = value headers, the first line of each key."""
    c = table(spark, folder, "customer")
    lines = c.select(F.concat("c_custkey", F.lit(".rsc")).alias("file"), F.posexplode(F.array(F.concat(F.lit("WIDTH = "), F.col("c_nationkey") * 100), F.lit("NOISE = 1"), F.concat(F.lit(" LENGTH="), "c_mktsegment"), F.lit("WIDTH = 0"))).alias("pos", "value"))
    return S.key_values(lines, ["WIDTH", "LENGTH"])


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id || '.EOF' WHEN page_id % 3 = 1 THEN 'want' || page_id END AS file FROM (SELECT CAST(page_id AS BIGINT) AS page_id FROM pages)")
def source_slice_orbits(spark: SparkSession, folder: str) -> DataFrame:
    """The listed orbit file, else the slice's own."""
    p = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("id"))
    third = F.pmod(F.col("id").cast("int"), F.lit(3))
    lines = p.select(F.concat("id", F.lit(":want"), "id").alias("value"))
    files = p.where(third != 2).select(F.when(third == 0, F.concat("id", F.lit(".EOF"))).otherwise(F.concat(F.lit("want"), "id")).alias("file"))
    return S.slice_orbits(lines, files).select(F.col("slice").cast("long").alias("page_id"), "file")


@query("SELECT l_orderkey, round(sum(l_tax), 4) AS total, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey")
def source_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The third column of whitespace tables, where it is a finite number."""
    line = table(spark, folder, "lineitem")
    third = F.when(F.col("l_linenumber") == 3, "NaN").otherwise(F.col("l_tax").cast("string"))
    lines = line.select("l_orderkey", F.concat_ws("  ", F.lit(" a"), F.lit("b"), third, F.lit("d")).alias("value"))
    return S.numbers(lines, 3).groupBy("l_orderkey").agg(F.round(F.sum("x"), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'unwrapped' WHEN 1 THEN 'coherence' WHEN 2 THEN 'dem' END AS kind FROM supplier")
def source_archive_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of product files by name."""
    s = table(spark, folder, "supplier")
    name = F.concat(F.lit("S1_"), "s_suppkey", F.element_at(F.array(F.lit("_unw_phase.tif"), F.lit("_corr.tif"), F.lit("_dem.tif"), F.lit("_browse.png")), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")))
    return s.select("s_suppkey", S.archive_kind(name).alias("kind"))


@query("SELECT tile, row, col, CASE WHEN v % 7 = 0 THEN -9999 WHEN v % 11 = 0 THEN -9999 ELSE v END::DOUBLE AS value FROM pixels".replace("CASE WHEN v % 7 = 0 THEN -9999 WHEN v % 11 = 0 THEN -9999 ELSE v END::DOUBLE", "CAST(CASE WHEN v % 7 = 0 OR v % 11 = 0 THEN -9999 ELSE v END AS DOUBLE)"))
def sink_export_values(spark: SparkSession, folder: str) -> DataFrame:
    """Missing and infinite values become the no-data value."""
    from .adapters import pixels

    v = F.when(F.pmod("v", F.lit(7)) == 0, F.lit(float("nan"))).when(F.pmod("v", F.lit(11)) == 0, F.lit(float("inf"))).otherwise(F.col("v").cast("double"))
    p = pixels(spark, folder).select("tile", "row", "col", v.alias("value"), F.lit("velocity").alias("dataset"))
    return S.export_values(p).select("tile", "row", "col", "value")


@query(with_pairs("SELECT stack, count(DISTINCT (ref, sec)) AS n_pairs, len(list_distinct(list_concat(list(ref), list(sec)))) AS n_scenes FROM usable GROUP BY stack"))
def sink_stack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document a stack, read back and counted."""
    docs = S.stack_documents(P.primary_pairs(collapsed(spark, folder)))
    d = F.from_json("document", "pairs array<array<string>>, scenes array<long>")
    return docs.select("stack", d.alias("d")).select("stack", F.size("d.pairs").cast("long").alias("n_pairs"), F.size("d.scenes").cast("long").alias("n_scenes"))


@query(with_pairs("SELECT stack, stage, count(*) AS n_expected, CAST(count(*) FILTER (WHERE (ref + sec) % (stage + 2) <> 0) AS BIGINT) AS n_done FROM usable, (SELECT unnest([1, 2, 3]) AS stage) GROUP BY stack, stage"))
def progress_of_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Expected products of each stage against the listing."""
    p = P.primary_pairs(collapsed(spark, folder))
    expected = p.select("stack", "ref", "sec", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("stage"))
    done = expected.where("(ref + sec) % (stage + 2) != 0").select("ref", "sec", "stage", F.lit(True).alias("done"))
    return expected.join(done, ["ref", "sec", "stage"], "left").groupBy("stack", "stage").agg(F.count("*").alias("n_expected"), F.count("done").alias("n_done"))


@query(with_pairs("SELECT stack, CAST(min(CASE WHEN labelled THEN 1 ELSE 0 END) AS INT) AS use_labels, count(*) AS n FROM (SELECT stack, ref % 40 <> 0 AS labelled FROM usable) GROUP BY stack"))
def layers_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Component labels are used only if every pair has them."""
    p = P.primary_pairs(collapsed(spark, folder))
    label = p.where("ref % 40 != 0").select("ref", "sec", F.lit(True).alias("label"))
    return p.join(label, ["ref", "sec"], "left").groupBy("stack").agg(F.bool_and(F.col("label").isNotNull()).cast("int").alias("use_labels"), F.count("*").alias("n"))


@query("SELECT h.path AS path, h.rows AS modal, o.frame AS odd, o.n_days AS n_days FROM (SELECT path, arg_max(n_days, (c, -n_days)) AS rows FROM (SELECT path, n_days, count(*) AS c FROM (SELECT path, frame, count(DISTINCT day) // 8 AS n_days FROM scenes GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY path) h JOIN (SELECT path, frame, count(DISTINCT day) // 8 AS n_days FROM scenes GROUP BY 1, 2) o ON h.path = o.path AND o.n_days <> h.rows".replace("h.rows AS", 'h."rows" AS').replace("AS rows FROM", 'AS "rows" FROM').replace("<> h.rows", '<> h."rows"'))
def grids_odd_ones(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent shape of a track's grids, and those that differ."""
    shape = scenes(spark, folder).groupBy("path", "frame").agg(F.floor(F.countDistinct("day") / 8).alias("n_days"))
    n = shape.groupBy("path", "n_days").agg(F.count("*").alias("c"))
    modal = n.groupBy("path").agg(F.max_by("n_days", F.struct("c", -F.col("n_days"))).alias("modal"))
    return shape.join(modal, "path").where("n_days != modal").select("path", "modal", F.col("frame").alias("odd"), "n_days")
