"""Registered queries: pairs and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as N
from ..operators import graph as G
from ..operators import pairs as P
from .adapters import collapsed, scenes
from .registry import query

PAIRS = """, pairs AS (
  SELECT a.stack, a.scene AS ref, b.scene AS sec, a.t AS t_ref, b.t AS t_sec, b.t - a.t AS dt_days, round(abs(b.bperp_m - a.bperp_m), 5) AS bperp
  FROM collapsed a JOIN collapsed b ON a.stack = b.stack AND a.t < b.t AND b.t - a.t <= 120
), usable AS (SELECT * FROM pairs WHERE bperp <= 150 AND len(list_filter([6, 12, 24, 36, 48, 72, 96], lambda x: abs(dt_days - x) <= 3)) > 0)
"""


def with_pairs(sql: str) -> str:
    from .adapters import WITH

    return WITH + PAIRS + sql


@query(with_pairs("SELECT stack, ref, sec, dt_days, bperp FROM usable"))
def network_primary_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Usable pairs of one scene per day, by a self-join in day buckets."""
    return P.primary_pairs(collapsed(spark, folder)).select("stack", "ref", "sec", "dt_days", "bperp")


@query("SELECT a.stack, a.scene, count(*) AS n_later, max(b.t - a.t) AS dt_max, max(round(abs(b.bperp_m - a.bperp_m), 5)) AS bperp_max FROM collapsed a JOIN collapsed b ON a.stack = b.stack AND a.t < b.t GROUP BY 1, 2")
def network_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All combinations of a stack's scenes, gathered per earlier scene without forming them."""
    return P.later_scenes(collapsed(spark, folder))


@query(with_pairs("SELECT c.stack, c.scene, count(e.scene) AS degree, count(e.scene) < 2 AS is_low FROM collapsed c LEFT JOIN (SELECT stack, ref AS scene FROM usable UNION ALL SELECT stack, sec FROM usable) e ON e.stack = c.stack AND e.scene = c.scene GROUP BY 1, 2"))
def network_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each scene."""
    s = collapsed(spark, folder)
    return P.degrees(P.primary_pairs(s), s)


@query("SELECT stack, scene AS ref, x.s AS sec, x.t - t AS dt_days FROM (SELECT stack, scene, t, unnest([{s: lead(scene, 1) OVER w, t: lead(t, 1) OVER w}, {s: lead(scene, 2) OVER w, t: lead(t, 2) OVER w}, {s: lead(scene, 3) OVER w, t: lead(t, 3) OVER w}]) AS x FROM collapsed WINDOW w AS (PARTITION BY stack ORDER BY t, scene)) WHERE x.s IS NOT NULL AND x.t - t <= 48")
def network_short_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Each date with the next three within 48 days."""
    return P.sequential(collapsed(spark, folder), 3, 48)


@query("SELECT c.stack, f.scene AS ref, c.scene AS sec, c.t - f.t AS dt_days FROM collapsed c JOIN (SELECT * FROM collapsed QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t, scene) = 1) f ON c.stack = f.stack AND c.t > f.t")
def network_star(spark: SparkSession, folder: str) -> DataFrame:
    """A reference date before every other choice."""
    return P.topology(collapsed(spark, folder), reference=True, max_days=12)


@query(with_pairs("SELECT DISTINCT CASE WHEN dt_days > 0 THEN ref ELSE sec END AS ref, sec FROM usable WHERE ref % 10 <> 0 AND sec % 10 <> 0"))
def network_pair_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in any order and twice, against a catalogue that lacks some scenes."""
    s = collapsed(spark, folder)
    p = P.primary_pairs(s).select("ref", "sec")
    twice = p.unionAll(p.select(F.col("sec").alias("ref"), F.col("ref").alias("sec"))).unionAll(s.select(F.col("scene").alias("ref"), F.col("scene").alias("sec")))
    return P.canonical(twice, s.where("scene % 10 != 0"))[0]


@query(with_pairs("SELECT ref, sec FROM usable WHERE ref % 10 = 0 OR sec % 10 = 0"))
def network_lost_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of scenes that the catalogue lacks."""
    s = collapsed(spark, folder)
    return P.canonical(P.primary_pairs(s).select("ref", "sec"), s.where("scene % 10 != 0"))[1]


@query(with_pairs("SELECT stack, ref, sec, CASE WHEN ref % 3 = 0 THEN CAST(bperp AS BIGINT) WHEN sec % 2 = 0 THEN CAST(round_even(bperp * 10, 0) AS BIGINT) ELSE -1 END AS b, CASE WHEN ref % 3 = 0 THEN 0 WHEN sec % 2 = 0 THEN 1 ELSE 2 END AS source FROM (SELECT stack, ref, sec, round_even(bperp, 0) AS bperp FROM usable)"))
def network_baseline_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Precise (whole metres), embedded and service baselines; the first that has a pair."""
    p = P.primary_pairs(collapsed(spark, folder)).select("stack", "ref", "sec", F.bround("bperp", 0).alias("b"))
    tiers = [p.where("ref % 3 = 0").withColumn("b", F.col("b").cast("long")), p.where("sec % 2 = 0").withColumn("b", (F.col("b") * 10).cast("long")), p.withColumn("b", F.lit(-1).cast("long"))]
    return P.by_priority(tiers, ["stack", "ref", "sec"])


@query(with_pairs("SELECT stack, scene, component FROM (WITH RECURSIVE e AS (SELECT ref AS x, sec AS y FROM usable UNION ALL SELECT sec, ref FROM usable), r AS (SELECT scene AS x, scene AS y FROM collapsed UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS scene, min(y) AS component FROM r GROUP BY x) JOIN collapsed USING (scene)"))
def network_components(spark: SparkSession, folder: str) -> DataFrame:
    """What each scene reaches by usable pairs."""
    s = collapsed(spark, folder)
    return G.components(P.primary_pairs(s), s)


@query(with_pairs("""SELECT u.stack, u.ref, u.sec FROM usable u JOIN (SELECT stack, component, scene FROM lab) l ON u.ref = l.scene AND u.stack = l.stack JOIN (SELECT stack, component FROM (SELECT stack, component, count(*) AS n FROM lab GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY stack ORDER BY n DESC, component) = 1) b ON b.stack = l.stack AND b.component = l.component WHERE u.bperp <= 75""").replace("SELECT u.stack", """, kept AS (SELECT * FROM usable WHERE bperp <= 75), lab AS (SELECT c.stack, scene, component FROM (WITH RECURSIVE e AS (SELECT ref AS x, sec AS y FROM kept UNION ALL SELECT sec, ref FROM kept), r AS (SELECT scene AS x, scene AS y FROM collapsed UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS scene, min(y) AS component FROM r GROUP BY x) JOIN collapsed c USING (scene)) SELECT u.stack""", 1))
def network_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Bad pairs go, the largest component of each stack stays."""
    s = collapsed(spark, folder)
    return G.largest_component(P.primary_pairs(s, pb_max=75.0), s).select("stack", "ref", "sec")


@query()
def network_selected(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired network. Depends on the order of turns, so it has no SQL form; see the tests."""
    return G.select_pairs(collapsed(spark, folder)).select("stack", "ref", "sec", "dt_days", "bperp", "primary")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return P.primary_pairs(collapsed(spark, folder)).withColumn("coh", F.round(F.exp(-F.col("dt_days") / 60) * (1 - F.col("bperp") / 300), 6))


@query()
def network_adaptive_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The largest threshold that keeps enough pairs and one component; count, least, largest and median."""
    return G.adaptive_threshold(scored(spark, folder))


@query()
def network_spanning_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs over the threshold, and each stack's maximum spanning tree."""
    s = scored(spark, folder)
    tree = s.groupBy("stack").applyInPandas(lambda p: G.spanning_tree(p, "coh"), s.schema)
    return tree.unionByName(s.where("coh >= 0.6")).select("stack", "ref", "sec", "coh").distinct()


@query("SELECT c.stack, c.scene, round(c.bperp_m - f.bperp_m, 5) AS bperp, true AS resolved FROM collapsed c JOIN (SELECT * FROM collapsed QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t, scene) = 1) f USING (stack)")
def network_propagated_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Baselines summed along the chain of consecutive dates equal those against the anchor."""
    s = collapsed(spark, folder)
    b = s.select("scene", "bperp_m")
    p = P.sequential(s, 4).join(b.withColumnsRenamed({"scene": "ref", "bperp_m": "b1"}), "ref").join(b.withColumnsRenamed({"scene": "sec", "bperp_m": "b2"}), "sec").withColumn("signed", F.col("b2") - F.col("b1"))
    return G.propagated_baseline(p, s).withColumn("bperp", F.round("bperp", 5))


@query(with_pairs("SELECT DISTINCT strftime(DATE '1970-01-01' + CAST(t_ref AS INT), '%Y%m%d') || '_' || strftime(DATE '1970-01-01' + CAST(t_sec AS INT), '%Y%m%d') AS line FROM usable"))
def network_pair_list(spark: SparkSession, folder: str) -> DataFrame:
    """The sorted, distinct text lines of a pair list."""
    day = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")), "yyyyMMdd")
    return P.primary_pairs(collapsed(spark, folder)).select(F.concat_ws("_", day("t_ref"), day("t_sec")).alias("line")).distinct().orderBy("line")


@query(with_pairs("SELECT stack, count(*) AS n_pairs, count(DISTINCT ref) AS n_refs FROM usable WHERE dt_days >= 12 GROUP BY stack HAVING count(*) > 10"))
def network_screening(spark: SparkSession, folder: str) -> DataFrame:
    """Stacks with more than ten pairs."""
    return P.primary_pairs(collapsed(spark, folder)).where("dt_days >= 12").groupBy("stack").agg(F.count("*").alias("n_pairs"), F.countDistinct("ref").alias("n_refs")).where("n_pairs > 10")


@query(with_pairs("SELECT stack, scene, min(orbit) AS orbit, count(*) AS n_pairs FROM (SELECT stack, ref AS scene FROM usable UNION ALL SELECT stack, sec FROM usable) JOIN (SELECT scene, orbit FROM collapsed) USING (scene) GROUP BY 1, 2"))
def network_scene_list(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct scenes of the pairs with their orbits."""
    s = collapsed(spark, folder)
    return P.ends(P.primary_pairs(s)).join(s.select("scene", "orbit"), "scene").groupBy("stack", "scene").agg(F.min("orbit").alias("orbit"), F.count("*").alias("n_pairs"))


@query(with_pairs("SELECT stack, ref, sec FROM usable WHERE dt_days <= 60 AND bperp <= 100 AND NOT (t_ref % 30 = 0 OR t_sec % 30 = 0) AND t_ref >= 9500"))
def network_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Interval and baseline limits, a first date, excluded dates."""
    p = P.primary_pairs(collapsed(spark, folder)).where("dt_days <= 60 AND bperp <= 100 AND t_ref >= 9500")
    out = scenes(spark, folder).where("t % 30 = 0").select("t").distinct()
    return p.join(out.withColumnRenamed("t", "t_ref"), "t_ref", "left_anti").join(out.withColumnRenamed("t", "t_sec"), "t_sec", "left_anti").select("stack", "ref", "sec")


@query(with_pairs("SELECT stack, CASE WHEN t_ref <= t_sec THEN ref || ':' || sec ELSE sec || ':' || ref END AS pair, CASE WHEN score >= 40 THEN 'good' WHEN score >= 25 THEN 'risky' ELSE 'bad' END AS class, CAST(score AS BIGINT) AS score FROM (SELECT *, round(100 - dt_days / 1.2 + bperp % 7) AS score FROM usable)"))
def network_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scores met on either orientation, with their class."""
    p = P.primary_pairs(collapsed(spark, folder))
    key = N.pair_key(F.col("ref"), F.col("sec"), F.col("t_ref"), F.col("t_sec"))
    back = N.pair_key(F.col("sec"), F.col("ref"), F.col("t_sec"), F.col("t_ref"))
    score = F.round(100 - F.col("dt_days") / 1.2 + F.col("bperp") % 7).cast("long")
    stored = p.select(back.alias("pair"), score.alias("score"))
    got = p.select("stack", key.alias("pair")).join(stored, "pair", "left")
    return got.select("stack", "pair", P.quality_class(F.col("score"), hundred=True).alias("class"), "score")
