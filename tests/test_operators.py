"""Operators without a SQL form against loops on small inputs; values of functions; sources from files."""

import datetime
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackweave.functions import catalog as N
from stackweave.functions import geo, scores, sql
from stackweave.operators import catalog, coherence, features, graph, inversion, pairs
from stackweave.sources import tables, xml


def stacks(seed=1, n=24):
    r = random.Random(seed)
    return [(f"s{k}", k * 1000 + i, 12 * i + r.randint(0, 3), r.uniform(-200, 200)) for k in range(3) for i in range(n)]


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame(stacks(), "stack string, scene long, t long, bperp_m double")


def usable(dt, bp):
    return any(abs(dt - x) <= 3 for x in pairs.TARGETS) and dt <= 120 and bp <= 150


def candidates():
    out = {}
    for a, b in itertools.combinations(sorted(stacks(), key=lambda s: (s[0], s[2], s[1])), 2):
        dt, bp = b[2] - a[2], round(abs(b[3] - a[3]), 5)
        if a[0] == b[0] and 0 < dt <= 120 and bp <= 150:
            out[a[1], b[1]] = (dt, bp)
    return out


@pytest.mark.parametrize("dt_max", [7, 30, 120])
def test_bucketed_pairs_equal_all_pairs(scenes, dt_max):
    near = pairs.all_pairs(scenes, dt_max)
    every = pairs.all_pairs(scenes).where(F.col("dt_days") <= dt_max)
    assert near.exceptAll(every).isEmpty() and every.exceptAll(near).isEmpty()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_repair(scenes, parts):
    """Step by step, as the rules say: boost scenes in turn, then trim scenes in turn."""
    when = {s[1]: s[2] for s in stacks()}
    cost, turn = candidates(), sorted(when, key=lambda s: (when[s], s))
    edge = lambda a, b: (a, b) if (when[a], a) < (when[b], b) else (b, a)
    net = {e for e, c in cost.items() if usable(*c)}
    links = lambda s: {x for e in net for x in e if s in e and x != s}
    for s in turn:
        others = sorted((o for o in turn if o != s and edge(s, o) in cost), key=lambda o: (abs(when[o] - when[s]), when[o], o))
        for o in others:
            if len(links(s)) >= 3:
                break
            net.add(edge(s, o))
    for s in turn:
        while len(links(s)) > 5:
            worst = sorted(links(s), key=lambda o: (*cost[edge(s, o)], o), reverse=True)
            pick = [o for o in worst if len(links(o)) >= 4] or [o for o in worst if len(links(o)) >= 3]
            if not pick:
                break
            net.discard(edge(s, pick[0]))
    got = {(r["ref"], r["sec"]) for r in graph.select_pairs(scenes.repartition(parts)).collect()}
    assert got == net


def test_repair_between_gaps(spark):
    """A stack with long gaps gives what its parts give alone."""
    rows = [(s, i + 500 * g, t + 1000 * g, b) for s, i, t, b in stacks(seed=5, n=12) for g in range(3)]
    got = graph.select_pairs(spark.createDataFrame(rows, "stack string, scene long, t long, bperp_m double"))
    assert graph.parts_at_gaps(spark.createDataFrame(rows, "stack string, scene long, t long, bperp_m double"), 120).select("stack").distinct().count() == 9
    for g in range(3):
        own = [r for r in rows if 1000 * g <= r[2] < 1000 * (g + 1)]
        alone = graph.select_pairs(spark.createDataFrame(own, "stack string, scene long, t long, bperp_m double"))
        assert {(r["ref"], r["sec"]) for r in got.where(F.col("t_ref").between(1000 * g, 1000 * g + 999)).collect()} == {(r["ref"], r["sec"]) for r in alone.collect()}


@pytest.mark.parametrize("days", [20, 150, 10_000])
def test_components_of_pairs(scenes, days):
    p = pairs.all_pairs(scenes, 40).where("(ref + sec) % 3 = 0")
    up = {s[1]: s[1] for s in stacks()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in p.select("ref", "sec").collect():
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["scene"]: r["component"] for r in graph.components(p, scenes, days).collect()}
    assert got == {x: root(x) for x in up} and 3 < len(set(got.values())) < len(up)


def test_star_components(spark):
    links = spark.createDataFrame([("a", i + 1, i) for i in range(40)] + [("b", 40, 7), ("b", 7, 7), ("b", None, 3)], "k string, u long, v long")
    got = {(r["k"], r["id"]): r["component"] for r in graph.star_components(links, ["k"]).collect()}
    assert got == {**{("a", i): 0 for i in range(41)}, ("b", 40): 7, ("b", 7): 7}
    with pytest.raises(RuntimeError):
        graph.star_components(links, ["k"], rounds=1)


def test_preferred_forest():
    """The forest that takes links in turn, unless their ends are joined already."""
    r = np.random.default_rng(3)
    for _ in range(20):
        n, m = int(r.integers(1, 30)), int(r.integers(0, 60))
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        label, want = list(range(n)), []
        for x, y in zip(a.tolist(), b.tolist()):
            want.append(label[x] != label[y])
            label = [label[x] if v == label[y] else v for v in label]
        assert graph.preferred_forest(n, a, b).tolist() == want


def test_later_scenes(scenes):
    p = pairs.all_pairs(scenes).groupBy("stack", F.col("ref").alias("scene")).agg(F.count("*").alias("n_later"), F.max("dt_days").alias("dt_max"), F.max("bperp").alias("bperp_max"))
    got = pairs.later_scenes(scenes)
    assert got.exceptAll(p).isEmpty() and p.exceptAll(got).isEmpty()


def test_burst_pairs(spark):
    """Pairs are chosen by date; each burst that has both dates gives one."""
    rows = [("s", b, 100 * b + i, 12 * i, 10.0 * i + b) for i in range(8) for b in range(3) if (i, b) != (4, 2)]
    s = spark.createDataFrame(rows, "stack string, burst long, scene long, t long, bperp_m double")
    got = {(r["burst"], r["t_ref"], r["t_sec"]): (r["ref"], r["sec"]) for r in graph.burst_pairs(s).collect()}
    dates = {(r["t_ref"], r["t_sec"]) for r in graph.burst_pairs(s).collect()}
    assert got == {(b, x, y): (100 * b + x // 12, 100 * b + y // 12) for x, y in dates for b in range(3) if b != 2 or 48 not in (x, y)}
    assert len(dates) > 7


def test_adaptive_threshold(scenes):
    scored = pairs.all_pairs(scenes, 60).withColumn("coh", F.round(F.exp(-F.col("dt_days") / 40) + F.pmod("ref", F.lit(7)) / 100, 6))
    got = {r["stack"]: r for r in graph.adaptive_threshold(scored).collect()}
    for stack, p in scored.toPandas().groupby("stack"):
        nodes = set(p["ref"]) | set(p["sec"])

        def fits(t):
            kept = p[p["coh"] >= t]
            seen, todo = set(), [min(nodes)]
            near = {}
            for a, b in kept[["ref", "sec"]].itertuples(index=False):
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near.get(x, [])
            return seen == nodes and len(kept) >= max(1, round(1.5 * (len(nodes) - 1)))

        best = max((t for t in np.round(np.arange(0, 1.1, 0.001), 3) if fits(t)), default=None)
        assert got[stack]["threshold"] == pytest.approx(best)


def test_corrections_of_dates(spark):
    """Shifts without noise come back, and the first date stays zero."""
    r = random.Random(4)
    value = {t: (0.0 if t == 0 else r.uniform(-1, 1)) for t in range(0, 120, 12)}
    rows = [("s", a, b, value[b] - value[a]) for a, b in itertools.combinations(value, 2) if b - a <= 36] + [("s", 0, 12, None)]
    out = inversion.date_corrections(spark.createDataFrame(rows, "stack string, t_ref long, t_sec long, shift double")).collect()
    assert all(r["correction"] == pytest.approx(value[r["t"]], abs=1e-9) and r["full_rank"] and r["n_failed"] == 1 for r in out)
    assert {r["t"]: r["correction"] for r in out}[0] == 0
    use = {r["t"]: r["use"] for r in inversion.applied(inversion.date_corrections(spark.createDataFrame(rows, "stack string, t_ref long, t_sec long, shift double"))).collect()}
    assert not use[0] and use[12]


@pytest.mark.parametrize("kind", ["plain", "weighted", "L1"])
def test_pixel_inversion(spark, kind):
    t, net = [0, 6, 12, 30], [(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)]
    truth = np.array([0.0, 1.0, -0.5, 2.0])
    phase = [float(truth[j] - truth[i]) for i, j in net]
    rows = [(0, 0, phase, [1.0] * 5), (0, 1, [*phase[:4], None], [1.0, 2.0, 1.0, 1.0, 1.0])]
    got = inversion.invert_pixels(spark.createDataFrame(rows, "row long, col long, phase array<double>, weight array<double>"), net, t, weighted=kind == "weighted", norm="L1" if kind == "L1" else "L2").collect()
    for r in got:
        assert r["value"] == pytest.approx(truth[t.index(r["t"])], abs=1e-6)
        assert r["coherence"] == pytest.approx(1) and r["n_used"] == (5 if r["col"] == 0 else 4)


def test_deramp_and_functions(spark):
    rows = [(i, j, t, 3.0 + 0.5 * i * t - 0.2 * j + (1.0 if (i, j) == (2, 2) else 0.0)) for i in range(5) for j in range(4) for t in (0, 12, 24)]
    ts = spark.createDataFrame(rows, "row long, col long, t long, value double")
    out = inversion.deramped(ts, mask="NOT (row = 2 AND col = 2)").collect()
    assert all(r["value"] == pytest.approx(1.0 if (r["row"], r["col"]) == (2, 2) else 0.0, abs=1e-6) for r in out)
    far = [(1_000_000 + i, 2_000_000 + j, 0, 1e3 + 0.3 * i * i - 0.1 * i * j + j) for i in range(30) for j in range(30)]
    left = inversion.deramped(spark.createDataFrame(far, ts.schema), inversion.QUADRATIC).agg(F.max(F.abs("value"))).first()[0]
    assert left < 1e-6
    high = spark.createDataFrame([(i, 0, 0, 5.0 + 2.0 * (1000 + i) - 0.01 * (1000 + i) ** 2) for i in range(50)], ts.schema)
    assert inversion.without_height(high, "1000 + row", 2).agg(F.max(F.abs("value"))).first()[0] < 1e-6
    t = [0.0, 100.0, 200.0, 365.25, 500.0, 730.5]
    y = [2 + 3 * x / 365.25 + (4 if x >= 200 else 0) for x in t]
    one = spark.createDataFrame([(0, 0, y), (0, 1, [*y[:5], None])], "row long, col long, values array<double>")
    got = {(r["col"], r["name"]): r["coefficient"] for r in inversion.fit_series(one, t, poly=1, steps=[200]).collect()}
    for c in (0, 1):
        assert [got[c, n] for n in ("poly0", "poly1", "step200")] == pytest.approx([2, 3, 4])


def test_bootstrap(spark):
    """A line without noise has no spread; noise has about that of the fit's own error; the result is the same in every run."""
    r = random.Random(2)
    t = [12 * k for k in range(40)]
    rows = [(i, 0, x, 3.0 + 2.0 * x / 365.25) for i in range(3) for x in t] + [(i, 1, x, r.gauss(0, 1)) for i in range(60) for x in t] + [(0, 2, 0, 1.0), (1, 2, 0, None)]
    ts = spark.createDataFrame(rows, "row long, col long, t long, value double")
    got = {(r["row"], r["col"]): r for r in inversion.bootstrap_velocity(ts, 200).collect()}
    assert all(got[i, 0]["velocity_std"] < 1e-9 and got[i, 0]["n"] == 200 for i in range(3))
    x = np.array(t) / 365.25
    want = 1 / np.sqrt(((x - x.mean()) ** 2).sum())
    assert np.mean([got[i, 1]["velocity_std"] for i in range(60)]) == pytest.approx(want, rel=0.15)
    assert (got[0, 2]["velocity_std"], got[0, 2]["n"]) == (None, 0) and (1, 2) not in got
    again = inversion.bootstrap_velocity(ts.repartition(3), 200)
    assert {(r["row"], r["col"]): r["velocity_std"] for r in again.collect()} == {k: r["velocity_std"] for k, r in got.items()}
    w = inversion.poisson_weights(np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert [np.mean(w == k) for k in range(3)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.005)


def test_decay_fit():
    lag = np.array([12.0, 24, 36, 48])
    truth = np.array([[0.1, 0.9, 20.0], [0.0, 0.6, 50.0]])
    coh = truth[:, :1] + (truth[:, 1:2] - truth[:, :1]) * np.exp(-lag / truth[:, 2:])
    g, a, tau = coherence.fit(lag, coh)
    back = g[:, None] + (a - g)[:, None] * np.exp(-lag / tau[:, None])
    assert np.abs(back - coh).max() < 0.01
    short = coherence.fit(lag, np.array([[0.5, np.nan, np.nan, 0.2], [0.2, 0.3, 0.4, 0.5], [0.5, 0.4, np.nan, 0.3]]))
    assert [x[0] for x in short] == list(coherence.NO_FIT) and [x[1] for x in short] == list(coherence.NO_FIT)
    assert short[2][2] != 30.0


def test_season_segments(spark):
    d = spark.createDataFrame([(datetime.date(2020, 2, 20), datetime.date(2020, 6, 10), 45.0), (datetime.date(2020, 2, 20), datetime.date(2020, 3, 1), 45.0), (datetime.date(2020, 7, 1), datetime.date(2020, 7, 1), -30.0)], "a date, b date, lat double")
    got = [[tuple(x) for x in r[0]] for r in d.select(coherence.season_segments(F.col("a"), F.col("b"), F.col("lat"))).collect()]
    assert got == [[(10, "winter"), (92, "spring"), (9, "summer")], [(10, "winter")], [(1, "winter")]]


def spans_of(d1, d2, south):
    """(season, days) of a span, day by day."""
    names = ["winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "fall", "fall", "fall", "winter"]
    seasons = [names[((d1 + datetime.timedelta(k)).month - 1 + (6 if south else 0)) % 12] for k in range((d2 - d1).days)]
    return [(s, len(list(g))) for s, g in itertools.groupby(seasons)]


@pytest.mark.parametrize("south", [False, True])
def test_chained_coherence(spark, south):
    """Day by day over the seasons of each span, for pairs and for the mean over pixels."""
    r = random.Random(7)
    zero = datetime.date(1970, 1, 1)
    first = (datetime.date(2019, 1, 1) - zero).days
    rows = [("s", i, first + d, 0.0) for i, d in enumerate(sorted(r.sample(range(500), 40) + [59, 151, 424]))]
    s = spark.createDataFrame(rows, "stack string, scene long, t long, bperp_m double")
    p = pairs.all_pairs(coherence.season_days(s, F.lit(-10.0 if south else 10.0)), 200, coherence.SEASON_COLUMNS)
    par = {"winter": (0.1, 0.8, 20.0), "spring": (0.2, 0.9, 40.0), "fall": (0.15, 0.7, 30.0)}
    table = spark.createDataFrame([(k, *v) for k, v in par.items()], "season string, g_inf double, g0 double, tau double")
    got = {(r["ref"], r["sec"]): r for r in coherence.chained(p, table, ["ref", "sec"]).collect()}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if 0 < y[2] - x[2] <= 200:
            want[x[1], y[1]] = spans_of(zero + datetime.timedelta(x[2]), zero + datetime.timedelta(y[2]), south)
    assert got.keys() == want.keys() and {len(v) for v in want.values()} >= {1, 2, 3}

    def value(seg, of):
        n = sum(d for _, d in seg)
        g, a = (sum(d * of[k][c] for k, d in seg) / n for c in (0, 1))
        return g + (a - g) * np.exp(-sum(d / of[k][2] for k, d in seg)), g

    for k, seg in want.items():
        assert got[k]["n_segments"] == len(seg)
        if any(x == "summer" for x, _ in seg):
            assert (got[k]["coh"], got[k]["floor"]) == (None, 0.0)
        else:
            assert (got[k]["coh"], got[k]["floor"]) == pytest.approx(value(seg, par), abs=6e-5)
    pixels = {i: {k: (v[0] + i / 100, v[1], v[2] + i) for k, v in {**par, "summer": (0.3, 0.6, 10.0)}.items() if (i, k) != (2, "winter")} for i in range(5)}
    maps = spark.createDataFrame([(i, k, *v) for i, x in pixels.items() for k, v in x.items()], "px long, season string, g_inf double, g0 double, tau double")
    got = {(r["ref"], r["sec"]): r for r in coherence.pixel_chained(p, maps, ["ref", "sec"], ["px"]).collect()}
    for k, seg in want.items():
        own = [value(seg, x) for x in pixels.values() if all(n in x for n, _ in seg)]
        assert got[k]["n_pixels"] == len(own) and got[k]["coh"] == pytest.approx(np.mean([max(v) for v in own]), abs=6e-5)
        assert got[k]["floor"] == pytest.approx(np.mean([f for _, f in own]), abs=6e-5)


def test_lagrange(spark):
    v = spark.createDataFrame([("o", float(t), float(t**3 - 2 * t)) for t in range(0, 200, 10)], "k string, at double, value double")
    t = spark.createDataFrame([("o", x) for x in (3.0, 95.5, 188.0)], "k string, t double")
    got = features.lagrange(t, v, "k").collect()
    assert all(r["n_used"] == 8 and r["value"] == pytest.approx(r["t"] ** 3 - 2 * r["t"]) for r in got) and len(got) == 3


def test_filter_stacks_in_order(spark):
    """Coverage before the limit, the limit before the count; the first item decides for its stack."""
    rows = [("a", 1, "f", i, i, "up" if i == 0 else "down", 0.0 if i % 2 else 50.0) for i in range(10)] + [("b", 2, "f", 100 + i, i, "down", 0.0) for i in range(3)]
    s = spark.createDataFrame(rows, "stack string, path long, frame string, scene long, t long, direction string, west double").withColumns({"day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int")), "south": F.lit(0.0), "east": F.col("west") + 10, "north": F.lit(10.0)})
    area = dict(min_coverage=0.5, aoi=(0, 0, 10, 10))
    ids = lambda **k: [r["scene"] for r in catalog.filter_stacks(s, **k).orderBy("scene").collect()]
    assert ids(direction="UP", **area, earliest=2) == [1, 3]
    assert ids(**area, earliest=4, min_count=4) == [1, 3, 5, 7]
    assert ids(**area, latest=2, min_count=2) == [7, 9, 101, 102]
    assert ids(direction="down") == [100, 101, 102] and ids(stacks=[(2, "f")], start="2024-01-02") == [101, 102]
    assert len(ids()) == 13 and catalog.search(s, aoi=(55, 0, 58, 5)).count() == 5
    with pytest.raises(ValueError):
        catalog.search(s, paths=[3])


def test_name_list(spark):
    d = spark.createDataFrame([(1, "S1A_IW_SLC__1SDV_20200101T000000, short\n # S1A_IW_SLC__1SDV_20200102T000000\nS1A_IW_SLC__1SDV_20200101T000000 not_a_scene"), (2, None), (3, "#all of it S1A_IW_SLC__1SDV_20200103T000000")], "doc_id long, text string")
    assert [tuple(r) for r in catalog.name_list(d).collect()] == [("S1A_IW_SLC__1SDV_20200101T000000", 1, 0)]


def test_fire_days(spark):
    spots = spark.createDataFrame([(5.0, 5.0, 100), (5.0, 15.0, 200), (-3.5, 0.5, 300)], "lat double, lon double, t long")
    areas = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, -1.0, -4.0, 5.0, 5.0)], "site long, west double, south double, east double, north double")
    got = {(r["site"], r["t"]) for r in features.fire_days(spots, areas).collect()}
    assert got == {(s, h + d) for s, h in ((1, 100), (2, 100), (2, 300)) for d in range(-3, 4)}
    p = spark.createDataFrame([(1, 50, 97), (1, 103, 300), (1, 104, 112), (2, 297, 310), (3, 100, 101)], "site long, t_d1 long, t_d2 long")
    assert {(r["site"], r["t_d1"]): r["fire"] for r in features.with_fire(p, features.fire_days(spots, areas)).collect()} == {(1, 50): True, (1, 103): True, (1, 104): False, (2, 297): True, (3, 100): False}


def test_reanalysis(spark, tmp_path):
    """Only the months of the dates are read; means skip nulls; missing hours take the nearest."""
    hour = lambda d, h: datetime.datetime(2020, 1, d, h)
    names = ["d2m", "skt", "u10", "v10", "ssr", "str", "smlt", "swvl2", "swvl3", "lai_hv", "lai_lv"]
    rows = [(hour(d, h), lat, 0.0, 273.15 + h, 280.0, 3.0, 4.0, 10.0 if lat else None, -2.0, 0.5, 0.1, 0.2, 1.0, 2.0) for d in (1, 2) for h in (10, 16) for lat in (0.0, 1.0, 9.0)]
    rows.append((datetime.datetime(2020, 3, 1), 0.0, 0.0, *[1.0] * 11))
    grid = spark.createDataFrame(rows, "time timestamp, lat double, lon double, " + ", ".join(f"{n} double" for n in names))
    tables.write_reanalysis(grid, str(tmp_path / "cells"))
    dates = spark.createDataFrame([(datetime.date(2020, 1, 1), 11), (datetime.date(2020, 1, 2), None), (datetime.date(2020, 1, 3), 5)], "day date, hour int")
    read = tables.read_reanalysis(spark, str(tmp_path / "cells"), dates)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan) and read.count() == 12
    got = {r["day"].day: r for r in features.reanalysis_days(features.area_means(read, -1, -1, 1, 2), dates).collect()}
    assert (got[1]["dewpoint"], got[2]["dewpoint"], got[3]["dewpoint"]) == (10.0, 16.0, None)
    assert (got[1]["wind_speed"], got[1]["net_radiation"], got[1]["snowmelt"], got[2]["hour"]) == (5.0, 16.0, 1.0, 17)


def test_reanalysis_of_a_full_month(spark, tmp_path):
    """A month's cells are sorted and written by several tasks."""
    grid = spark.range(4000).selectExpr("timestamp_seconds(1577836800 + id % 700 * 3600) AS time", "id % 20 / 10 AS lat", "id % 30 / 10 AS lon", "CAST(id AS DOUBLE) AS d2m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_reanalysis(grid, str(tmp_path / "cells"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "cells").glob("year=2020/month=1/*.parquet"))
    most = max(spark.read.parquet(str(f)).count() for f in files)
    back = tables.read_reanalysis(spark, str(tmp_path / "cells"), spark.sql("SELECT DATE '2020-01-05' AS day"))
    assert len(files) > 1 and most < 2000 and back.count() == 4000 and back.agg(F.sum("d2m")).first()[0] == 4000 * 3999 / 2


def test_pair_tables_and_scores(spark):
    docs = spark.createDataFrame([("a", '{"pairs": [["1", "2"], ["1", "2"]]}'), ("b", '{"pairs": [["3", "4"]]}')], "stack string, document string")
    old = spark.createDataFrame([("b", '[["8", "9"]]'), ("c", '[["5", "6"]]')], "stack string, text string")
    flat = spark.createDataFrame([('[["7", "8"]]',)], "text string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(tables.pairs_of_stacks(docs, old, flat)) == [("a", "1", "2"), ("b", "3", "4"), ("c", "5", "6")]
    assert rows(tables.pairs_of_stacks(docs, old, explicit=old.limit(1))) == [("a", "1", "2"), ("b", "8", "9"), ("c", "5", "6")]
    assert rows(tables.pairs_of_stacks(docs.limit(0), old.limit(0), flat)) == [(None, "7", "8")]
    scores = spark.createDataFrame([("a", 1, 2, 0.5), ("b", 3, 4, None)], "stack string, ref long, sec long, score double")
    scenes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "stack string, scene long")
    stored = tables.stored_scores(tables.score_documents(scores, scenes).unionByName(tables.score_documents(scores, scenes, version=1)))
    assert rows(stored.select("stack", "n_scenes", "n_pairs", "complete")) == [("a", 2, 1, True), ("b", 2, 1, True)]
    more = scenes.unionAll(spark.createDataFrame([("b", 5), ("c", 1)], "stack string, scene long"))
    assert rows(tables.to_rebuild(stored, more)) == [("a", False), ("b", True), ("c", True)]


def test_export_and_listing(spark, tmp_path):
    rows = [("velocity", "20200101", 1, 0, 2.5), ("velocity", "20200101", 0, 0, float("nan")), ("maskTempCoh", "20200101", 0, 0, 3.0), ("maskTempCoh", "20200102", 0, 0, None)]
    tables.write_export(spark.createDataFrame(rows, "dataset string, date string, row long, col long, value double"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["dataset"], r["date"], r["row"]): r["value"] for r in back.collect()} == {("velocity", 20200101, 1): 2.5, ("velocity", 20200101, 0): -9999.0, ("maskTempCoh", 20200101, 0): 1.0, ("maskTempCoh", 20200102, 0): 255.0}
    with pytest.raises(Exception):
        tables.export_values(spark.createDataFrame([("other", "20200101", 0, 0, 1.0)], "dataset string, date string, row long, col long, value double")).collect()
    for name in ("S1_unw_phase.tif", "x/S1_corr.tif", "x/S1_browse.png"):
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(b"12345")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["bytes"]) for r in tables.listing(spark, str(tmp_path / "files")).collect()}
    assert got == {"S1_unw_phase.tif": ("unwrapped", 5), "S1_corr.tif": ("coherence", 5), "S1_browse.png": (None, 5)}


def test_names_and_dates(spark):
    name = "S1A_IW_SLC__1SDV_20200101T000000_20200101T000030_030000_038000_1234"
    d = spark.createDataFrame([(name,), ("20240115",), ("not_a_scene",), (None,)], "n string")
    assert [r[0] for r in d.select(N.scene_date(F.col("n"))).collect()] == ["20200101", "20240115", "", ""]
    ends = spark.createDataFrame([("2024-01-15",), ("2024-01-15T05:00:00",), ("2024-01-15 05:00:00",), ("",), (None,)], "d string")
    assert [r[0] for r in ends.select(N.end_of_day(F.col("d"))).collect()] == ["2024-01-15T23:59:59", "2024-01-15T05:00:00", "2024-01-15 05:00:00", "", None]
    ion = spark.createDataFrame([("codg0450.19i",), ("COD0OPSFIN_20240450000_01D_01H_GIM.INX",)], "f string")
    assert [str(r[0]) for r in ion.select(N.ionosphere_day(F.col("f"))).collect()] == ["2019-02-14", "2024-02-14"]
    one = spark.range(1)
    got = one.select(scores.season_penalty(F.lit(1), F.lit(7), F.lit(45.0)), scores.season_penalty(F.lit(4), F.lit(10), F.lit(45.0)), scores.season_penalty(F.lit(1), F.lit(4), F.lit(-10.0)), scores.annual_repeat(F.lit(735)), scores.annual_repeat(F.lit(1825), 4)).first()
    assert tuple(got) == (0.95, 0.70, 0.35, True, False)
    assert one.select(scores.wind_speed(F.lit(3.0), F.lit(4.0)), scores.wind_speed(F.lit(0.0), F.lit(4.0))).first()[:] == (5.0, None)


def test_coverage(spark):
    square, tilted = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, -2), (6, 2), (2, 6), (-2, 2)]
    assert geo.clip_area(square, square) == pytest.approx(16)
    assert geo.clip_area(tilted, square) == pytest.approx(16)
    assert geo.clip_area([(2, 2), (6, 2), (6, 6), (2, 6)], square[::-1]) == pytest.approx(4)
    f = spark.createDataFrame([([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)],), ([(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)],), (None,)], "p array<struct<lon: double, lat: double>>")
    assert [r[0] for r in f.select(geo.coverage(square)("p")).collect()] == [pytest.approx(0.25), 0.0, None]


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT sw_unit(7), sw_quality_class(0.3), sw_annual_repeat(370, 4), sw_end_of_day('2024-01-15'), round(sw_decay(0.1, 0.9, 10, 0), 6)").first()
    assert tuple(r) == (1.0, "risky", True, "2024-01-15T23:59:59", 0.9)


def test_xml_sources(spark, tmp_path):
    osv = "<Earth_Explorer_File><Data_Block><List_of_OSVs>" + "".join(f'<OSV><UTC>UTC=2024-11-19T00:00:{s:02d}.000000</UTC><X unit="m">{s}.5</X><Y unit="m">2</Y><Z unit="m">3</Z><VX unit="m/s">4</VX><VY unit="m/s">5</VY><VZ unit="m/s">6</VZ></OSV>' for s in (0, 10)) + "</List_of_OSVs></Data_Block></Earth_Explorer_File>"
    (tmp_path / "a.EOF").write_text(osv)
    rows = sorted(xml.orbit_vectors(spark, str(tmp_path / "a.EOF")).collect(), key=lambda r: r["t"])
    assert [(r["file"], r["x"], r["vz"]) for r in rows] == [("a.EOF", 0.5, 6.0), ("a.EOF", 10.5, 6.0)] and rows[1]["t"] - rows[0]["t"] == 10
    note = "<product><orbitList>" + "<orbit><time>2024-01-01T00:00:00</time><position><x>1</x><y>2</y><z>3</z></position></orbit></orbitList><geolocationGrid>" + "".join(f"<geolocationGridPoint><latitude>{a}</latitude><longitude>{b}</longitude></geolocationGridPoint>" for a, b in ((1, 5), (3, 7))) + "</geolocationGrid></product>"
    (tmp_path / "b.xml").write_text(note)
    assert xml.annotation_orbits(spark, str(tmp_path / "b.xml")).first()["z"] == 3
    c = xml.annotation_centres(spark, str(tmp_path / "b.xml")).first()
    assert (c["lat"], c["lon"]) == (2, 6)
    m = spark.createDataFrame([("<gml:coordinates>10.5,20 11,21 12,22</gml:coordinates>",)], "m string")
    assert [tuple(p) for p in m.select(xml.footprint(F.col("m"))).first()[0]] == [(20, 10.5), (21, 11), (22, 12)]
    files = spark.createDataFrame([("p", "x/s1a-iw1.xml"), ("p", "x/s1a-iw2.xml"), ("p", "x/calibration/iw2.xml")], "product string, path string")
    assert xml.preferred_annotation(files).first()["path"] == "x/s1a-iw2.xml"


def test_tables(spark, tmp_path):
    short = spark.createDataFrame([("a 1 2 3 4",), ("b 1",), ("c 5 6 7 8",)], "value string")
    assert sorted(r["name"] for r in tables.baseline_rows(short).collect()) == ["a", "c"]
    with pytest.raises(Exception, match="two dates"):
        tables.baseline_rows(short.where("value NOT LIKE 'c%'")).collect()
    maps = spark.createDataFrame([("winter", "vv", 0, 0, 0.1, 0.9, 20.0), ("winter", "vv", 0, 1, float("nan"), 0.9, 20.0)], "season string, pol string, row int, col int, g_inf double, g0 double, tau double")
    tables.write_decay_maps(maps, str(tmp_path / "maps"))
    back = {r["col"]: (r["g_inf"], r["tau"], r["valid"]) for r in tables.read_decay_maps(spark, str(tmp_path / "maps")).collect()}
    assert back == {0: (0.1, 20.0, True), 1: (0.0, 30.0, False)}
    assert coherence.covers(maps, 0, 1).count() == 1 and coherence.covers(maps, 5, 1).count() == 0
    with pytest.raises(Exception, match="required layer"):
        tables.required_layers(spark.createDataFrame([("p", "dem")], "product string, kind string")).collect()
    (tmp_path / "x_corr.tif").write_text("1")
    kinds = {r["kind"] for r in tables.listing(spark, str(tmp_path / "*.tif")).collect()}
    assert kinds == {"coherence"}


def test_stored_features(spark):
    store = spark.createDataFrame([("geometry", "a", 1, 100), ("geometry", "a", 2, 200), ("geometry", "b", 3, 100), ("weather", "a", 4, 1)], "section string, key string, value int, fetched int")
    want = spark.createDataFrame([("geometry", "a"), ("geometry", "b"), ("weather", "a"), ("weather", "z")], "section string, key string")
    valid, missing = features.fresh(store, want, 500, {"geometry": 365})
    assert {(r["section"], r["key"], r["value"]) for r in valid.collect()} == {("geometry", "a", 2), ("weather", "a", 4)}
    assert {(r["section"], r["key"]) for r in missing.collect()} == {("geometry", "b"), ("weather", "z")}
    assert features.fresh(store, want, 500, {"geometry": 365}, refresh=True)[0].count() == 0


def test_components_of_long_chains(spark):
    s = spark.createDataFrame([("a", i, i) for i in range(60)] + [("b", 100, 1)], "stack string, scene long, t long")
    p = spark.createDataFrame([("a", i, i + 1) for i in range(59) if i != 30], "stack string, ref long, sec long")
    got = {r["scene"]: r["component"] for r in graph.components(p, s).collect()}
    assert got == {**{i: 0 if i <= 30 else 31 for i in range(60)}, 100: 100}
    kept = graph.largest_component(p, s)
    assert kept.count() == 30
    assert isinstance(kept.toPandas(), pd.DataFrame)


def test_propagated_baseline_of_long_chains(spark):
    s = spark.createDataFrame([("a", i, i) for i in range(300)] + [("a", 900, 900), ("b", 7, 1)], "stack string, scene long, t long")
    p = spark.createDataFrame([("a", i, i + 1, 0.5) for i in range(299)], "stack string, ref long, sec long, signed double")
    got = {(r["stack"], r["scene"]): (r["bperp"], r["resolved"]) for r in graph.propagated_baseline(p, s).collect()}
    assert got == {**{("a", i): (i / 2, True) for i in range(300)}, ("a", 900): (0.0, False), ("b", 7): (0.0, True)}


def test_sql_functions_equal_columns(spark):
    """The functions for SQL users give what the column functions give, nulls included."""
    sql.register(spark)
    name = "S1A_IW_SLC__1SDV_20200101T134501_20200101T000030_030000_038000_1234"
    day = datetime.date(2021, 3, 9)
    rows = [(name, "Sentinel-1B", "134501", day, 12.5, -3.4, 0.2), ("20240115", None, "233001", datetime.date(2020, 12, 31), -45.0, 0.0, 0.41), (None, "x", None, None, None, 7.0, None)]
    d = spark.createDataFrame(rows, "name string, platform string, hms string, day date, x double, y double, z double")
    c = F.col
    both = {
        "sw_scene_date(name)": N.scene_date(c("name")), "sw_scene_hour(name)": N.scene_hour(c("name")), "sw_start_stamp(name)": N.start_stamp(c("name")), "sw_mission(platform)": N.mission(c("platform")), "sw_round_hour(hms)": N.round_hour(c("hms")),
        "sw_composite_code(day)": N.composite_code(c("day")), "sw_composite_day(sw_composite_code(day))": c("day"), "sw_day_offset_id(day)": N.day_offset_id(c("day")), "sw_pair_key(name, platform, day, date'2021-01-01')": N.pair_key(c("name"), c("platform"), c("day"), F.lit("2021-01-01").cast("date")),
        "sw_tile_lat(x, 3)": N.tile_lat(c("x"), 3), "sw_tile_lon(x, 1)": N.tile_lon(c("x")), "sw_freeze_thaw(x, y)": scores.freeze_thaw(c("x"), c("y")), "sw_snow_delta(x, z)": scores.snow_delta(c("x"), c("z")), "sw_wind_speed(x, y)": scores.wind_speed(c("x"), c("y")), "sw_celsius(x)": scores.celsius(c("x")),
        "sw_coherence_penalty(z)": scores.coherence_penalty(c("z")), "sw_rescaled(z, 1.2)": scores.rescaled(c("z"), F.lit(1.2)), "sw_rescaled(z, 2)": scores.rescaled(c("z"), F.lit(2)), "sw_los_up(z, z)": geo.los_up(c("z"), c("z")), "sw_vertical(x, z)": geo.vertical(c("x"), c("z")), "sw_route(x * 1000)": pairs.route(c("x") * 1000), "sw_band_of(x)": coherence.band_of(c("x")),
        "sw_decay(z, y, 20, 6)": scores.decay(c("z"), c("y"), F.lit(20), F.lit(6)), "sw_unit(x)": scores.unit(c("x")), "sw_end_of_day(name)": N.end_of_day(c("name")), "sw_area_key(name)": scores.area_key(c("name")), "sw_metres(x, 0.05546576)": geo.phase_to_metres(c("x")),
    }
    for r in d.select(*(F.struct(F.expr(k).alias("a"), v.alias("b")).alias(str(i)) for i, (k, v) in enumerate(both.items()))).collect():
        for k, x in zip(both, r):
            assert x["a"] == pytest.approx(x["b"]) if isinstance(x["b"], float) else x["a"] == x["b"], k
