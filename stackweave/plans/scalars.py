"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..functions import geo as G
from ..functions import scores as Q
from ..operators import pairs as P
from .adapters import collapsed, scenes, table
from .network import with_pairs
from .registry import query


@query("SELECT s.stack, s.scene, s.t - f.t AS days FROM scenes s JOIN (SELECT stack, min(t) AS t FROM scenes GROUP BY stack) f USING (stack)")
def scalar_days_since_first(spark: SparkSession, folder: str) -> DataFrame:
    """Days since the stack's first acquisition."""
    s = scenes(spark, folder)
    return s.join(s.groupBy("stack").agg(F.min("t").alias("first")), "stack").select("stack", "scene", (F.col("t") - F.col("first")).alias("days"))


@query(with_pairs("""SELECT stack, scene, round(p - zero, 9) + 0.0 AS position FROM (SELECT stack, scene, avg(p) AS p FROM (SELECT stack, ref AS scene, -bperp / 2 AS p FROM usable UNION ALL SELECT stack, sec, bperp / 2 FROM usable) GROUP BY 1, 2)
JOIN (SELECT stack, arg_min(p, (t, scene)) AS zero FROM (SELECT stack, scene, avg(p) AS p FROM (SELECT stack, ref AS scene, -bperp / 2 AS p FROM usable UNION ALL SELECT stack, sec, bperp / 2 FROM usable) GROUP BY 1, 2) JOIN (SELECT scene, t FROM collapsed) USING (scene) GROUP BY stack) USING (stack)"""))
def scalar_half_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of scenes from half baselines."""
    s = collapsed(spark, folder)
    return P.half_baseline_positions(P.primary_pairs(s), s).withColumn("position", F.round("position", 9))


@query("SELECT scene, CASE WHEN scene % 9 = 0 THEN 'missing' WHEN abs(bperp_m * 25) > 5000 THEN 'fallback' ELSE 'ok' END AS route FROM scenes")
def scalar_baseline_routes(spark: SparkSession, folder: str) -> DataFrame:
    """implausible baselines go to the fallback, missing ones are marked."""
    return scenes(spark, folder).select("scene", P.route(F.when(F.pmod("scene", F.lit(9)) != 0, F.col("bperp_m") * 25)).alias("route"))


@query("SELECT scene, CAST(CASE WHEN abs(off) > 600 THEN off - round_even(off / 5929.0::DOUBLE, 0) * 5929 ELSE off END AS BIGINT) AS off FROM (SELECT scene, scene * 7919 % 40000 - 20000 AS off FROM scenes)")
def scalar_node_times(spark: SparkSession, folder: str) -> DataFrame:
    """Node times brought back by whole revolutions."""
    off = F.pmod(F.col("scene") * 7919, F.lit(40000)) - 20000
    return scenes(spark, folder).select("scene", P.repaired_node_time(off, F.lit(0)).cast("long").alias("off"))


@query("SELECT c_custkey, round(0.1 + (0.9 - 0.1) * exp(-(c_custkey % 60) / 20.0::DOUBLE), 9) AS coherence, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN round(sqrt(power(c_custkey % 5, 2) + power(c_custkey % 7, 2)), 9) END AS wind, round(c_acctbal - 273.15, 4) AS celsius, substr(sha256(c_name), 1, 8) AS area FROM customer")
def scalar_units(spark: SparkSession, folder: str) -> DataFrame:
    """Decay, wind and temperature units, area keys."""
    k = F.col("c_custkey")
    part = lambda n: F.pmod(k, F.lit(n)).cast("double")
    return table(spark, folder, "customer").select("c_custkey", F.round(Q.decay(F.lit(0.1), F.lit(0.9), F.lit(20.0), part(60)), 9).alias("coherence"), F.round(Q.wind_speed(part(5), part(7)), 9).alias("wind"), F.round(Q.celsius(F.col("c_acctbal")), 4).alias("celsius"), Q.area_key(F.col("c_name")).alias("area"))


@query("SELECT s_suppkey, r AS range, round(degrees(asin(least(1.0::DOUBLE, (6371000.0::DOUBLE + h) / 6371000.0 * sin(acos((r * r + (6371000.0::DOUBLE + h) * (6371000.0::DOUBLE + h) - 6371000.0::DOUBLE * 6371000.0) / (2 * r * (6371000.0::DOUBLE + h))))))), 6) AS incidence FROM (SELECT s_suppkey, CAST(850000 + s_suppkey % 50 * 1000 AS DOUBLE) AS r, 693000.0::DOUBLE AS h FROM supplier)")
def scalar_look_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Range and incidence at a scene's centre."""
    r = (850_000 + F.pmod("s_suppkey", F.lit(50)) * 1000).cast("double")
    a = G.look_angle(r - 10_000, r + 10_000, F.lit(693_000.0))
    return table(spark, folder, "supplier").select("s_suppkey", a["range"].alias("range"), F.round(a["incidence"], 6).alias("incidence"))


@query("SELECT scene, CAST(day AS VARCHAR) AS day FROM scenes")
def scalar_ionosphere_days(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of ionosphere files of both naming eras."""
    doy, year = F.date_format("day", "DDD"), F.date_format("day", "yyyy")
    old = F.concat(F.lit("codg"), doy, F.lit("0."), F.substring(year, 3, 2), F.lit("i"))
    new = F.concat(F.lit("COD0OPSFIN_"), year, doy, F.lit("0000_01D_01H_GIM.INX"))
    name = F.when(F.pmod("scene", F.lit(2)) == 0, old).otherwise(new)
    return scenes(spark, folder).select("scene", N.ionosphere_day(name).cast("string").alias("day"))
