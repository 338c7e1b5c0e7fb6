"""Polygons, mosaics, crops and class groups against brute force and plain cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.functions.geo import clip_area
from stackweave.operators import coherence, mosaics, polygons

POINTS = "id long, points array<struct<lon: double, lat: double>>"
GRID = "layer long, x0 double, y0 double, dx double, dy double, n_rows long, n_cols long"


def star(r, n, x, y, size):
    """A simple polygon, concave as a rule."""
    return [(x + size * r.uniform(0.25, 1) * math.cos(2 * math.pi * (k + 0.3) / n), y + size * r.uniform(0.25, 1) * math.sin(2 * math.pi * (k + 0.3) / n)) for k in range(n)]


def brute_share(area, footprint):
    parts = polygons.convex_parts(polygons.ring(np.array(area)))
    return sum(clip_area(footprint, p.tolist()) for p in parts) / abs(polygons.signed_area(np.array(area)))


def inside(p, x, y):
    q = [*p[1:], p[0]]
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, q)) % 2 == 1


@pytest.mark.parametrize("step", [1.0, 0.37])
def test_coverage(spark, step):
    r = random.Random(5)
    areas = {i: star(r, r.randint(3, 9), r.uniform(-4, 4), r.uniform(-4, 4), r.uniform(0.2, 3)) for i in range(14)}
    feet = {i: star(r, r.choice([3, 4, 4, 6]), r.uniform(-4, 4), r.uniform(-4, 4), r.uniform(0.5, 4)) for i in range(25)}
    areas[50], feet[50] = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]
    rows = lambda d: [(i, [*p, p[0]] if i % 2 else p[::-1]) for i, p in d.items()] + [(900, None), (901, []), (902, [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)])]
    got = polygons.coverage(spark.createDataFrame(rows(areas), POINTS).withColumnRenamed("id", "a"), spark.createDataFrame(rows(feet), POINTS).withColumnRenamed("id", "f"), "a", "f", step=step)
    got = {(x["a"], x["f"]): x["share"] for x in got.collect()}
    want = {(i, j): brute_share(a, f) for i, a in areas.items() for j, f in feet.items()}
    assert {k for k, v in want.items() if v > 1e-7} <= set(got) <= {k for k, v in want.items() if v > 1e-13}
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-7)
    assert got[50, 50] == pytest.approx(1)


def test_convex_parts_fill_the_ring():
    r = random.Random(1)
    for _ in range(60):
        p = polygons.ring(np.array(star(r, r.randint(3, 14), 0, 0, 2)))
        parts = polygons.convex_parts(p)
        assert sum(polygons.signed_area(x) for x in parts) == pytest.approx(polygons.signed_area(p))
    with pytest.raises(ValueError):
        polygons.convex_parts(np.array([(0, 0), (4, 0), (0, 1), (4, 1), (2, -3), (2, 4.0)]))


def test_covered(spark):
    a = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], POINTS).withColumnRenamed("id", "a")
    f = spark.createDataFrame([(7, [(1.0, 0.0), (3.0, 0.0), (3.0, 2.0), (1.0, 2.0)], "x"), (8, [(1.9, 0.0), (3.0, 0.0), (3.0, 2.0), (1.9, 2.0)], "y")], POINTS.replace("id", "f") + ", name string")
    assert [(r["a"], r["f"], r["name"], round(r["share"], 9)) for r in polygons.covered(a, f, "a", "f", 0.25).collect()] == [(1, 7, "x", 0.5)]


def test_coverage_of_the_same_polygons(spark):
    """Copies are clipped once and come back whole; a key of several rows has all its polygons; nothing is broadcast."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    areas = [(i, box(0.0, 0.0, 2.0, 2.0)) for i in range(40)] + [(50, box(5.0, 5.0, 1.0, 1.0)), (50, box(7.0, 5.0, 1.0, 1.0))]
    feet = [(i, box(1.5, 0.5, 3.0, 1.0)) for i in range(70)] + [(None, box(7.0, 4.5, 1.0, 1.0))]
    a, f = spark.createDataFrame(areas, POINTS).withColumnRenamed("id", "a"), spark.createDataFrame(feet, POINTS).withColumnRenamed("id", "f")
    got = polygons.coverage(a, f, "a", "f")
    assert {(r["a"], r["f"]): round(r["share"], 9) for r in got.collect()} == {**{(i, j): 0.125 for i in range(40) for j in range(70)}, (50, None): 0.25}
    assert polygons.shapes(f, "f", "points")[1].count() == 2
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_covered_at_the_limit(spark):
    """A tenth itself counts, whichever way it is rounded."""
    from stackweave.plans import ground

    kind = F.pmod("s", F.lit(3))
    own = spark.createDataFrame([(143, 4078), (44, 5096), (569, 14954), (608, 2500), (68, 5180), (53, 11418)], "s long, c long")
    a = own.select(F.col("s").alias("area"), kind.alias("kind"), (F.pmod("s", F.lit(170)) - 85 + F.pmod("s", F.lit(10)) / 10).alias("x"), (F.pmod("s", F.lit(110)) - 55 + F.pmod("s", F.lit(7)) / 8).alias("y"))
    a = a.select("area", F.when(F.col("kind") == 0, ground.corners(*ground.SHAPES[0])).when(F.col("kind") == 1, ground.corners(*ground.SHAPES[1])).otherwise(ground.corners(*ground.SHAPES[2])).alias("points"))
    f = own.select(F.col("c").alias("scene"), (F.pmod("c", F.lit(700)) / 4 - 85).alias("x"), (F.pmod("c", F.lit(331)) / 3 - 55).alias("y"))
    f = f.select("scene", ground.corners((0, 0), (2.5, 0), (2.5, 1.75), (0, 1.75), (0, 0)).alias("points"))
    got = {(r["area"], r["scene"]) for r in polygons.covered(a, f, "area", "scene", 0.1).collect()}
    assert {(r["s"], r["c"]) for r in own.collect()} <= got


def test_area_cell_means(spark):
    """Areas of the same cells share their means; nulls are left out; a cell of several rows counts them all."""
    cells = spark.createDataFrame([(k, i, j) for k in range(30) for i, j in ((0, 0), (0, 1))] + [(90, 0, 1), (91, 5, 5)], "area long, i long, j long")
    rows = [(h, 0.0, lon, v, w) for h in range(3) for lon, v, w in ((0.0, 1.0, None), (0.1, 2.0, None), (0.1, 6.0, 4.0 if h else None))]
    grid = spark.createDataFrame(rows, "time int, lat double, lon double, v double, w double")
    got = polygons.area_cell_means(grid, cells, "area")
    want = {(k, h): (3.0, 4.0 if h else None) for k in range(30) for h in range(3)} | {(90, h): (4.0, 4.0 if h else None) for h in range(3)}
    assert {(r["area"], r["time"]): (r["v"], r["w"]) for r in got.collect()} == want
    # areas meet sums of a cell and a time, not the grid's rows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(s_v#" in plan and "sum(v#" in plan


def test_grid_cells(spark):
    r = random.Random(8)
    areas = {i: star(r, r.randint(3, 8), r.uniform(-2, 2), r.uniform(-2, 2), r.choice([0.04, 0.2, 1.0])) for i in range(40)}
    got = polygons.grid_cells(spark.createDataFrame([(i, [*p, p[0]]) for i, p in areas.items()] + [(99, None), (98, [])], POINTS), "id").collect()
    for i, p in areas.items():
        own = {(x["i"], x["j"]) for x in got if x["id"] == i}
        want = {(a, b) for a in range(-35, 36) for b in range(-35, 36) if inside(p, b / 10, a / 10)}
        if want:
            assert own == want
        else:
            lon, lat = zip(*p)
            assert own == {(a, b) for a in range(-35, 36) for b in range(-35, 36) if min(lat) <= a / 10 <= max(lat) and min(lon) <= b / 10 <= max(lon)}
            assert all(x["by_box"] for x in got if x["id"] == i)
    assert {x["id"] for x in got} <= set(areas)


def test_grid_cells_leave_out_the_edge(spark):
    box = [(1.1, 0.3), (1.7, 0.3), (1.7, 0.9), (1.1, 0.9)]
    got = polygons.grid_cells(spark.createDataFrame([(1, box)], POINTS), "id").collect()
    assert {(x["i"], x["j"]) for x in got} == {(i, j) for i in range(4, 9) for j in range(12, 17)}


def test_mosaic(spark):
    r = random.Random(2)
    grids = [(k, 100 + 0.5 * r.randint(0, 9), 50 - 0.25 * r.randint(0, 9), 0.5, -0.25, 6, 8) for k in range(5)]
    pix = [(g[0], i, j, *r.choice([(0.0, 0.0), (1.0 * g[0] + 1, 0.0), (0.0, float(i)), (float("nan"), 1.0), (None, 2.0), (float("inf"), 0.0)])) for g in grids for i in range(6) for j in range(8)]
    got = mosaics.first_valid(spark.createDataFrame(pix, "layer long, row long, col long, re double, im double"), spark.createDataFrame(grids, GRID), ["re", "im"])
    left, top = min(g[1] for g in grids), max(g[2] for g in grids)
    want = {}
    for k, i, j, re, im in pix:
        if re is not None and math.isfinite(re) and (re or im):
            g = grids[k]
            want.setdefault((i + round((top - g[2]) / 0.25), j + round((g[1] - left) / 0.5)), (re, im, k))
    assert {(x["row"], x["col"]): (x["re"], x["im"], x["layer"]) for x in got.collect()} == want


def test_mosaic_of_unlike_grids(spark):
    p = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0)], "layer long, row long, col long, v double")
    grids = spark.createDataFrame([(0, 0.0, 0.0, 0.5, -0.5, 2, 2), (1, 0.0, 0.0, 0.6, -0.5, 2, 2)], GRID)
    with pytest.raises(Exception, match="unlike posting"):
        mosaics.first_valid(p, grids, ["v"]).collect()
    with pytest.raises(Exception, match="no cell"):
        mosaics.first_valid(p, grids.where("layer = 0"), ["v"], (5, 5, 6, 6)).collect()
    assert mosaics.first_valid(p.limit(0), grids.where("layer = 0"), ["v"]).count() == 0
    assert mosaics.first_valid(p, grids.limit(0), ["v"]).count() == 0


def test_crop_leaves_out_layers(spark):
    grids = spark.createDataFrame([(0, 0.0, 10.0, 1.0, -1.0, 10, 10), (1, 2.0, 9.0, 1.0, -1.0, 10, 10), (2, 50.0, 9.0, 1.0, -1.0, 10, 10)], GRID)
    p = spark.createDataFrame([(k, i, j, k * 100 + i * 10 + j) for k in range(3) for i in range(10) for j in range(10)], "layer long, row long, col long, v long")
    got = mosaics.crop(p, grids, (1.0, 4.0, 5.0, 8.0), 1.0).groupBy("layer").agg(F.count("*"), F.min("v"), F.max("row"), F.max("col")).collect()
    assert sorted(map(tuple, got)) == [(0, 36, 10, 5, 5), (1, 24, 100, 5, 3)]
    got = mosaics.crop(p, grids, (1.0, 4.0, 5.0, 8.0), 1.0, common=True).groupBy("layer").agg(F.count("*"), F.min("v")).collect()
    assert sorted(map(tuple, got)) == [(0, 24, 12), (1, 24, 100)]


def test_levels_by_class_need_pixels(spark):
    cells = [(k, j, 50 if k == 0 else 10 if k == 1 else 7) for k in range(3) for j in range(40)]
    coh = [("winter", 12, k, j, 60 if j < 30 - k else 255) for k in range(3) for j in range(40)]
    got = coherence.levels_by_class(spark.createDataFrame(coh, "season string, lag long, row long, col long, coh long"), spark.createDataFrame(cells, "row long, col long, cls long"))
    assert [tuple(r) for r in got.collect()] == [("winter", "stable", 12, pytest.approx(0.6), 30)]
