"""The driver's tables seen as the domain's: scenes, date features, pixels; in Spark, and as SQL tables (WITH).

The same mappings stand in both: an order is a scene, the customer's nation and market segment its stack, a user of
events is a site, an embedding is a tile of 8 x 8 pixels, a line of an order a coherence sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = (12, 24, 36, 48)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(stack, path, frame, scene, name, start_time, t, bperp_m, polarization, level, platform, direction, orbit)"""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("stack"),
        F.col("c_nationkey").cast("long").alias("path"),
        F.col("c_mktsegment").alias("frame"),
        F.col("o_orderkey").cast("long").alias("scene"),
        F.concat(F.lit("S1A_IW_SLC__1SDV_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"), F.lpad(F.pmod("o_orderkey", F.lit(24)).cast("string"), 2, "0"), F.lit("0000_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name"),
        F.to_date("o_orderdate").alias("day"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("t"),
        (F.col("o_totalprice") / 1000 - 250).alias("bperp_m"),
        F.col("o_orderpriority").alias("polarization"),
        F.col("o_orderstatus").alias("level"),
        F.when(F.pmod("o_custkey", F.lit(2)) == 0, "ASCENDING").otherwise("DESCENDING").alias("direction"),
        F.concat(F.lit("Sentinel-1"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))).alias("platform"),
        F.pmod("o_orderkey", F.lit(175)).cast("long").alias("orbit"),
    )


def latitude(path: Column) -> Column:
    """The tables have no latitude: a path stands at one of its own, on both sides of the equator."""
    return (F.when(F.pmod(path, F.lit(2)) == 0, 1.0).otherwise(-1.0) * F.pmod(path * 7 + 3, F.lit(90))).cast("double")


def collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """scenes with one scene per stack and day."""
    from ..operators.catalog import collapse_by_date

    return collapse_by_date(scenes(spark, folder))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence samples (part, line, level, season, coh 0 to 100, v): lines of orders, by part."""
    line = table(spark, folder, "lineitem")
    return line.select(
        F.col("l_partkey").cast("long").alias("part"),
        F.col("l_orderkey").cast("long").alias("pair"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.element_at(F.array(*map(F.lit, LEVELS)), (F.pmod("l_linenumber", F.lit(4)) + 1).cast("int")).cast("long").alias("lag"),
        F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "fall"))), (F.floor((F.month("l_shipdate") % 12) / 3) + 1).cast("int")).alias("season"),
        F.round(F.col("l_quantity") * 2 - 2).cast("long").alias("coh"),
        (F.col("l_quantity") / 50).alias("v"),
    )


def site_days(spark: SparkSession, folder: str) -> DataFrame:
    """Per site and day: precip (purchases' values), temp (mean - 50), snow (share of errors), n."""
    e = table(spark, folder, "events")
    value = F.round("value", 2).cast("decimal(18,2)")
    return e.groupBy(F.col("user_id").cast("long").alias("site"), F.to_date("ts").alias("day")).agg(
        F.sum(F.when(F.col("event_type") == "purchase", value)).alias("precip"),
        (F.sum(value) / F.count("*") - 50).cast("double").alias("temp"),
        (F.sum((F.col("event_type") == "error").cast("int")) / F.count("*")).alias("snow"),
        F.count("*").alias("n"),
    ).withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, row, col, v): embeddings as tiles of 8 x 8, 16 tiles a row; v in thousandths, exact."""
    e = table(spark, folder, "embeddings")
    tile = e.select(F.col("vec_id").cast("long").alias("tile"), F.col("label").cast("long").alias("layer"), F.posexplode("embedding").alias("k", "x"))
    return tile.select(
        "layer",
        "tile",
        (F.floor(F.col("tile") / 16) * 8 + F.floor(F.col("k") / 8)).cast("long").alias("row"),
        (F.pmod("tile", F.lit(16)) * 8 + F.pmod("k", F.lit(8))).cast("long").alias("col"),
        F.round(F.col("x").cast("double") * 1000).cast("long").alias("v"),
    )


#: The same tables in SQL; every registered statement may use them.
WITH = """
WITH scenes AS (
  SELECT concat(c_nationkey, ':', c_mktsegment) AS stack, CAST(c_nationkey AS BIGINT) AS path, c_mktsegment AS frame, CAST(o_orderkey AS BIGINT) AS scene,
         concat('S1A_IW_SLC__1SDV_', strftime(o_orderdate, '%Y%m%d'), 'T', lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), '0000_', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS name,
         CAST(o_orderdate AS DATE) AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, o_totalprice / 1000 - 250 AS bperp_m,
         o_orderpriority AS polarization, o_orderstatus AS level, CASE WHEN o_custkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS direction,
         concat('Sentinel-1', substr('ABCD', CAST(o_orderkey % 4 + 1 AS INT), 1)) AS platform, CAST(o_orderkey % 175 AS BIGINT) AS orbit
  FROM orders JOIN customer ON o_custkey = c_custkey
), collapsed AS (
  SELECT * FROM scenes QUALIFY row_number() OVER (PARTITION BY stack, day ORDER BY t, scene) = 1
), samples AS (
  SELECT CAST(l_partkey AS BIGINT) AS part, CAST(l_orderkey AS BIGINT) AS pair, CAST(l_linenumber AS BIGINT) AS line,
         CAST(([12, 24, 36, 48])[CAST(l_linenumber % 4 + 1 AS INT)] AS BIGINT) AS lag,
         (['winter', 'spring', 'summer', 'fall'])[CAST((month(l_shipdate) % 12) // 3 + 1 AS INT)] AS season,
         CAST(round(l_quantity * 2 - 2) AS BIGINT) AS coh, l_quantity / 50 AS v
  FROM lineitem
), site_days AS (
  SELECT CAST(user_id AS BIGINT) AS site, CAST(ts AS DATE) AS day,
         sum(CAST(round(value, 2) AS DECIMAL(18, 2))) FILTER (WHERE event_type = 'purchase') AS precip,
         CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) / count(*) - 50 AS temp,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS snow, count(*) AS n,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS t
  FROM events GROUP BY 1, 2, 7
), pixels AS (
  SELECT CAST(label AS BIGINT) AS layer, CAST(vec_id AS BIGINT) AS tile, CAST((vec_id // 16) * 8 + k // 8 AS BIGINT) AS row, CAST((vec_id % 16) * 8 + k % 8 AS BIGINT) AS col,
         CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS v
  FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS k, unnest(embedding) AS x FROM embeddings)
)
"""
