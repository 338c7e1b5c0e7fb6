"""Edited networks against a plain reading; stores, maps, XML and exports: failures, pruning, odd input."""

import pytest
from pyspark.sql import functions as F

from stackweave.operators import editing, graph, pairs
from stackweave.operators.cut import place, temporary
from stackweave.sources import store, tables, xml

PAIRS = "stack string, ref long, sec long, t_ref long, t_sec long, dt_days long, bperp double, coh double, ratio double"


def network():
    out = []
    for s in ("a", "b"):
        t = [0, 6, 12, 30, 36, 60, 66]
        for i in range(7):
            for j in range(i + 1, min(i + 4, 7)):
                coh = None if (i, j) == (2, 4) else ((i * 5 + j * 3) % 10) / 10
                out.append((s, i, j, t[i], t[j], t[j] - t[i], float(i * j * 10 - 60), coh, None if (i, j) == (0, 1) else 0.5))
    return out


def kept(df):
    return {(r["stack"], r["ref"], r["sec"]) for r in df.collect()}


def test_edited(spark):
    rows = network()
    p = spark.createDataFrame(rows, PAIRS)
    every = {r[:3] for r in rows}
    assert kept(editing.edited(p)) == every
    assert kept(editing.edited(p, temp_max=24, perp_max=60)) == {r[:3] for r in rows if r[5] <= 24 and abs(r[6]) <= 60}
    assert kept(editing.edited(p, conn_max=1)) == {r[:3] for r in rows if r[2] - r[1] == 1}
    assert kept(editing.edited(p, start=6, end=60, exclude_dates=[30])) == {r[:3] for r in rows if r[3] >= 6 and r[4] <= 60 and 30 not in r[3:5]}
    some = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("c", 0, 1)], "stack string, ref long, sec long")
    assert kept(editing.edited(p, exclude_pairs=some)) == every - {("a", 0, 1), ("a", 2, 3)}
    assert kept(editing.edited(p, reference=some)) == {("a", 0, 1), ("a", 2, 3)}
    first = sorted(r[3:5] + r[:3] for r in rows if r[0] == "a")[0][2:]
    assert kept(editing.edited(p, exclude_index=spark.createDataFrame([("a", 0)], "stack string, index int"))) == every - {first}
    assert kept(editing.edited(p, min_coherence=0.4)) == {r[:3] for r in rows if r[7] is not None and r[7] >= 0.4}
    assert kept(editing.edited(p, min_ratio=0.4)) == every - {("a", 0, 1), ("b", 0, 1)}
    assert kept(editing.edited(p.limit(0), conn_max=1, min_coherence=0.1, keep_tree=True)) == set()


def test_edited_keeps_the_tree(spark):
    rows = network()
    got = kept(editing.edited(spark.createDataFrame(rows, PAIRS), temp_max=30, min_coherence=0.85, keep_tree=True))
    want = set()
    for s in ("a", "b"):
        own = sorted((r for r in rows if r[0] == s and r[5] <= 30 and r[7] is not None), key=lambda r: (-r[7], r[1], r[2]))
        label = {i: i for i in range(7)}
        for r in own:
            if label[r[1]] != label[r[2]]:
                old, new = label[r[1]], label[r[2]]
                label = {k: new if v == old else v for k, v in label.items()}
                want.add(r[:3])
        want |= {r[:3] for r in own if r[7] >= 0.85}
    assert got == want


def test_area_ratio(spark):
    d = spark.createDataFrame([("a", 1, 2, v) for v in (0.1, 0.5, 0.9, None, float("nan"))], "stack string, ref long, sec long, coh double")
    assert [r["ratio"] for r in editing.area_ratio(d, 0.5).collect()] == [pytest.approx(2 / 3)]


def test_topology_pairs_reach_the_largest_component(spark):
    """Pairs that carry no day of their own go through."""
    s = spark.createDataFrame([("a", i, 10 * i, 0.0) for i in range(5)] + [("a", 50 + i, 9000 + 10 * i, 0.0) for i in range(3)], "stack string, scene long, t long, bperp_m double")
    p = pairs.topology(s, max_connections=2, max_days=30) if "max_connections" in pairs.topology.__code__.co_varnames else pairs.sequential(s, 2, 30)
    assert "t_ref" not in p.columns
    got = graph.largest_component(p, s).collect()
    assert got and all(r["ref"] < 5 and r["sec"] < 5 for r in got)


def test_temporary_tables_of_components_go(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    s = spark.createDataFrame([("a", i, i) for i in range(30)], "stack string, scene long, t long")
    p = spark.createDataFrame([("a", i, i + 1) for i in range(29)], "stack string, ref long, sec long")
    before = set(folder.glob("*")) if folder.exists() else set()
    assert graph.components(p, s).count() == 30
    assert len(set(folder.glob("*")) - before) == 1


def stored(spark, path):
    return {(r["section"], r["key"]): (r["value"], r["fetched"]) for r in store.rows(spark, path).collect()}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "section string, key string, value string")
    assert stored(spark, path) == {}
    want = rows(("geometry", "a", None), ("weather", "b", None), ("weather", "z", None)).drop("value")
    assert {r["value"] for r in store.get(spark, path, want, 0).collect()} == {None}
    store.put(rows(("geometry", "a", "1"), ("weather", "b", "2"), ("weather", "c", "3"), ("weather", None, "x"), ("weather", "d", None)), path, 100)
    assert stored(spark, path) == {("geometry", "a"): ("1", 100), ("weather", "b"): ("2", None), ("weather", "c"): ("3", None)}
    store.put(rows(("weather", "b", "20"), ("weather", "b", "19"), ("weather", "e", "5")), path, 200)
    assert stored(spark, path) == {("geometry", "a"): ("1", 100), ("weather", "b"): ("20", None), ("weather", "c"): ("3", None), ("weather", "e"): ("5", None)}
    get = lambda now, **k: {(r["section"], r["key"]): r["value"] for r in store.get(spark, path, want, now, **k).collect()}
    assert get(465) == {("geometry", "a"): "1", ("weather", "b"): "20", ("weather", "z"): None}
    assert get(466)["geometry", "a"] is None
    assert set(get(100, refresh=True).values()) == {None}


def test_failed_write_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.put(spark.createDataFrame([("weather", str(i), "old") for i in range(50)], "section string, key string, value string"), path, 1)
    before = stored(spark, path)
    bad = spark.range(50).select(F.lit("weather").alias("section"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 49, F.raise_error(F.lit("killed"))).otherwise(F.lit("new")).alias("value"))
    with pytest.raises(Exception, match="killed"):
        store.put(bad, path, 2)
    assert stored(spark, path) == before


def test_seeded_store(spark, tmp_path):
    d = spark.createDataFrame([("weather", 1.5, -2.0, "20240101", "x"), ("snow", 1.5, -2.0, "20240101", None)], "section string, lat double, lon double, day string, value string")
    store.seed(d, str(tmp_path / "s"), 5)
    assert stored(spark, str(tmp_path / "s")) == {("weather", "1.500:-2.000:20240101"): ("x", None)}


def test_maps_read_only_what_is_wanted(spark, tmp_path):
    path = str(tmp_path / "maps")
    m = spark.range(40_000).select(F.element_at(F.array(F.lit("winter"), F.lit("summer")), (F.col("id") % 2 + 1).cast("int")).alias("season"), F.when(F.col("id") % 3 == 0, "VV").otherwise("VH").alias("pol"), F.floor(F.col("id") / 200).alias("row"), (F.col("id") % 200).alias("col"), F.lit(0.1).alias("g_inf"), F.lit(0.9).alias("g0"), F.lit(20.0).alias("tau"))
    tables.write_decay_maps(m, path)
    got = tables.read_decay_maps(spark, path, ["winter"], "VV", (10, 19, 0, 99))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [season" in plan.replace("isnotnull(season#", "season#").replace("PartitionFilters: [isnotnull(pol", "PartitionFilters: [season") and "row" in plan.split("PushedFilters")[1].split("]")[0]
    assert {f.split("season=")[1].split("/")[0] for f in got.inputFiles()} <= {"winter", "summer"}
    read = {(r["season"], r["pol"]) for r in got.select("season", "pol").distinct().collect()}
    assert read == {("winter", "VV")} and got.count() == m.where("season = 'winter' AND pol = 'VV' AND row BETWEEN 10 AND 19 AND col < 100").count()


def test_bands(spark, tmp_path):
    kind = "product string, dataset string, date string, row long, col long, value double, no_data double"
    rows = [("velocityERA5", "velocity", None, 0, 0, 1.0, None), ("velocity", "velocity", None, 0, 0, float("nan"), None), ("geo_timeseries", "timeseries", "20240101", 0, 0, 5.0, 5.0), ("maskConnComp", "x", None, 0, 0, 3.0, None), ("maskConnComp", "x", None, 0, 1, None, None), ("geo_demErr", "dem", None, 0, 0, 2.5, None), ("velocity", "unused", None, 0, 0, 1.0, None)]
    tables.write_bands(spark.createDataFrame(rows, kind), str(tmp_path / "b"))
    got = {(r["file"], r["band"], r["col"]): r["value"] for r in tables.read_bands(spark, str(tmp_path / "b")).collect()}
    assert got == {("velocityERA5_velocity", "velocity", 0): 1.0, ("velocity", "velocity", 0): -9999.0, ("geo_timeseries", "20240101", 0): -9999.0, ("maskConnComp", "maskConnComp", 0): 3.0, ("maskConnComp", "maskConnComp", 1): 255.0, ("geo_demErr", "demErr", 0): 2.5}
    assert tables.read_bands(spark, str(tmp_path / "b"), "velocity").count() == 1
    with pytest.raises(Exception, match="unknown product"):
        tables.export_bands(spark.createDataFrame([("ERA5x", "a", None, 0, 0, 1.0, None)], kind)).collect()


def test_xml_of_odd_documents(spark):
    d = spark.createDataFrame([(1, None), (2, "no xml"), (3, "<Earth_Explorer_File><Data_Block><List_of_OSVs><OSV><UTC>UTC=2024-01-01T00:00:10.500000</UTC><X unit=\"m\">1.5</X></OSV></List_of_OSVs></Data_Block></Earth_Explorer_File>")], "id long, document string")
    assert [(r["id"], r["t"], r["x"], r["y"]) for r in xml.vectors_of_orbits(d).collect()] == [(3, 1704067210.5, 1.5, None)]
    assert xml.parts_of_annotations(d).where("centre_time IS NOT NULL").count() == 0


def test_kept_tables_of_nested_scopes(spark):
    with temporary(spark) as outer:
        with temporary(spark) as keep:
            inner = keep(spark.range(3).toDF("x"), "inner")
            gone = place(spark, "gone")
            spark.range(2).write.parquet(gone)
        assert inner.count() == 3
        with pytest.raises(Exception):
            spark.read.parquet(gone)
        whole = outer(inner, "whole")
    assert whole.count() == 3
