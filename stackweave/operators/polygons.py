"""Polygons at scale: shares of areas that footprints cover, by cells; grid centres inside areas, by scan lines.

A polygon is an array<struct<lon, lat>>, closed or not, in planar degrees. For coverage both sides are cut along a grid
of cells. Where one side fills a cell, the other side's part of it is the answer; only cells that both sides cross are
clipped, many at once. So the join meets on cells and geometry is worked out once for each polygon and cell, and once for
polygons that are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import points_box

#: Cells of a degree along each axis of the grid for coverage.
CELL = 1.0
#: Share of a cell's area by which it may miss being filled, and share of an area by which one may miss a limit.
NEAR = 1e-9


def signed_area(p: np.ndarray) -> np.ndarray:
    """Of polygons (n, vertices, 2), counter-clockwise ones positive."""
    x, y = p[..., 0] - p[..., :1, 0], p[..., 1] - p[..., :1, 1]
    return (x * np.roll(y, -1, -1) - np.roll(x, -1, -1) * y).sum(-1) / 2


def cut_by_lines(p: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Polygons (n, v, 2) without what lies on the negative side; ``side`` (n, v) is each vertex's distance to its line.

    Shorter polygons repeat their last vertex; of a polygon that is gone all vertices are 0.
    """
    after, next_side = np.roll(p, -1, 1), np.roll(side, -1, 1)
    crosses = side * next_side < 0
    share = np.divide(side, side - next_side, out=np.zeros_like(side), where=crosses)
    both = np.stack([p, p + (after - p) * share[..., None]], 2).reshape(len(p), 2 * p.shape[1], 2)
    keep = np.stack([side >= 0, crosses], 2).reshape(len(p), 2 * p.shape[1])
    n = keep.sum(1)
    order = np.argsort(~keep, 1, kind="stable")[:, : max(1, int(n.max(initial=0)))]
    place = np.minimum(np.arange(order.shape[1])[None, :], np.maximum(n - 1, 0)[:, None])
    out = np.take_along_axis(both, np.take_along_axis(order, place, 1)[..., None], 1)
    out[n == 0] = 0
    return out


def clipped(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each polygon of p (n, v, 2) within the convex, counter-clockwise one of q (n, w, 2)."""
    for k in range(q.shape[1]):
        a, b = q[:, k, None], q[:, (k + 1) % q.shape[1], None]
        p = cut_by_lines(p, (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0]))
    return p


def ring(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise, without a closing or repeated vertex."""
    p = points[np.any(points != np.roll(points, 1, 0), 1)] if len(points) > 1 else points
    return p[::-1] if len(p) and signed_area(p) < 0 else p


def convex_parts(p: np.ndarray) -> list[np.ndarray]:
    """A ring as it is if it is convex, else in triangles, one ear after the other."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    at = lambda k: (p[k - 1], p[k], p[(k + 1) % len(p)])
    if len(p) < 3:
        return []
    if all(turn(*at(k)) >= 0 for k in range(len(p))):
        return [p]
    out, left = [], p.tolist()
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            others = [q for i, q in enumerate(left) if q not in (a, b, c)]
            if turn(a, b, c) >= 0 and not any(turn(a, b, q) >= 0 and turn(b, c, q) >= 0 and turn(c, a, q) >= 0 for q in others):
                break
        else:
            raise ValueError("a polygon's sides cross")
        out.append(np.array([a, b, c]))
        del left[k]
    return [*out, np.array(left)]


def padded(shapes: list[np.ndarray]) -> np.ndarray:
    """Polygons as one array; shorter ones repeat their last vertex."""
    n = np.array([len(s) for s in shapes])
    out = np.zeros((len(shapes), int(n.max(initial=1)), 2))
    for i, s in enumerate(shapes):
        out[i, : len(s)], out[i, len(s) :] = s, s[-1]
    return out


def pieces_of(shapes: list[np.ndarray], step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the shape, cell x, cell y, area, polygon) of all shapes cut along the grid, without empty pieces."""
    who, cx, cy = [], [], []
    for i, s in enumerate(shapes):
        (x0, y0), (x1, y1) = np.floor(s.min(0) / step).astype(int), np.floor(s.max(0) / step).astype(int)
        gx, gy = np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1))
        who.append(np.full(gx.size, i)), cx.append(gx.ravel()), cy.append(gy.ravel())
    who, cx, cy = (np.concatenate(v) if v else np.zeros(0, int) for v in (who, cx, cy))
    p = padded(shapes)[who] if len(who) else np.zeros((0, 1, 2))
    for axis, edge, sign in ((0, cx, 1), (0, cx + 1, -1), (1, cy, 1), (1, cy + 1, -1)):
        p = cut_by_lines(p, sign * (p[..., axis] - (edge * step)[:, None]))
    area = np.abs(signed_area(p))
    some = area > 0
    return who[some], cx[some], cy[some], area[some], p[some]


def alike(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(members (key, like), classes (like, value)): keys of one value are a class, which bears the smallest of them."""
    classes = rows.groupBy(value).agg(F.min(key).alias("like"))
    # Spark takes tables of small files for small, so that it would send these to the driver and to all machines
    return rows.join(classes.hint("merge"), value).select(key, "like"), classes


def shapes(polygons: DataFrame, key: str, points: str) -> tuple[DataFrame, DataFrame]:
    """alike() of each key's polygons (column polygons): as a rule one, several where rows repeat a key."""
    own = polygons.where(F.col(points).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(points)).alias("polygons"))
    return alike(own, "key", "polygons")


def cells(shapes: DataFrame, step: float = CELL) -> DataFrame:
    """(like, cx, cy, held, whole, parts, size): what area each shape (like, polygons) holds of each cell, and in all; parts, convex
    polygons as x, y, x, y ..., are null where it holds the whole cell. Shapes of no area have no cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, convex = [], []
            for i, polygons in enumerate(batch.column(1).to_pylist()):
                for points in polygons:
                    parts = convex_parts(ring(np.array([(p["lon"], p["lat"]) for p in points], float).reshape(-1, 2)))
                    owner += [i] * len(parts)
                    convex += parts
            who, cx, cy, area, p = pieces_of(convex, step)
            who = np.array(owner, np.int64)[who]
            order = np.lexsort((cy, cx, who))
            who, cx, cy, area, p = who[order], cx[order], cy[order], area[order], p[order]
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
            first, cell = np.flatnonzero(new), np.cumsum(new) - 1
            held, size = np.bincount(cell, area, len(first)), np.bincount(who, area, len(batch))
            whole = held >= step * step * (1 - NEAR)
            some = ~whole[cell]
            ends = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = p[some].reshape(-1)
            each = pa.ListArray.from_arrays(pa.array(ends(np.full(some.sum(), p.shape[1] * 2))), pa.array(values))
            parts = pa.ListArray.from_arrays(pa.array(ends(np.bincount(cell[some], minlength=len(first)))), each)
            columns = [batch.column(0).take(pa.array(who[first])), pa.array(cx[first]), pa.array(cy[first]), pa.array(held), pa.array(whole), parts, pa.array(size[who[first]])]
            yield pa.RecordBatch.from_arrays(columns, ["like", "cx", "cy", "held", "whole", "parts", "size"])

    kind = dict(shapes.dtypes)["like"]
    n = 4 * shapes.sparkSession.sparkContext.defaultParallelism  # small rows, much work
    return shapes.select("like", "polygons").repartition(n, "like").mapInArrow(run, f"like {kind}, cx long, cy long, held double, whole boolean, parts array<array<double>>, size double")


def polygons_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of polygons of each row, all polygons) of lists of polygons as x, y, x, y ..."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    each = column.flatten()
    size = pc.list_value_length(each).to_numpy(zero_copy_only=False) // 2
    xy = each.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    place = np.minimum(np.arange(size.max(initial=1))[None, :], size[:, None] - 1)
    return n, xy[(np.cumsum(size) - size)[:, None] + place]


def shared_areas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(area, footprint, known, parts of both, size) -> (area, footprint, shared, size): known, or the parts of one clipped by those of the other."""
    for b in batches:
        known = b.column(2).to_numpy(zero_copy_only=False)
        (n, left), (m, right) = polygons_of(b.column(3)), polygons_of(b.column(4))
        times = np.where(np.isnan(known), n * m, 0)
        row = np.repeat(np.arange(len(b)), times)
        k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        one, two = left[(np.cumsum(n) - n)[row] + k // m[row]], right[(np.cumsum(m) - m)[row] + k % m[row]]
        each = np.abs(signed_area(clipped(one, two)))
        shared = np.where(np.isnan(known), np.bincount(row, each, len(b)), known)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared), b.column(5)], ["a", "f", "shared", "size"])


def coverage(areas: DataFrame, footprints: DataFrame, area: str, footprint: str, points: str = "points", step: float = CELL) -> DataFrame:
    """(area, footprint, share): the share of each area of interest that each footprint covers, where it covers any.

    Areas and footprints may be concave. Geometry is worked out once for areas and footprints that are the same. The join
    meets on cells of the grid; a cell that very many footprints share is split by Spark's skew join.
    """
    (a_members, a_shapes), (f_members, f_shapes) = shapes(areas.where(F.col(area).isNotNull()), area, points), shapes(footprints, footprint, points)
    side = lambda d, p: d.select("cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("like", "held", "whole", "parts", "size")))
    both = side(cells(a_shapes, step), "a").join(side(cells(f_shapes, step), "f").hint("merge"), ["cx", "cy"])
    known = F.when(F.col("a_whole"), F.col("f_held")).when(F.col("f_whole"), F.col("a_held"))
    parts = [F.when(known.isNull(), F.col(f"{p}_parts")).alias(p) for p in "af"]
    kinds = [dict(both.dtypes)[c] for c in ("a_like", "f_like")]
    each = both.select("a_like", "f_like", known.alias("known"), *parts, F.col("a_size").alias("size")).mapInArrow(shared_areas, f"a {kinds[0]}, f {kinds[1]}, shared double, size double")
    total = each.groupBy("a", "f").agg((F.sum("shared") / F.max("size")).alias("share")).where("share > 0")
    member = lambda d, p: d.select(F.col("key").alias(f"_{p}"), F.col("like").alias(f"_{p}_like")).hint("merge")
    found = total.join(member(a_members, "a"), F.col("a") == F.col("_a_like")).join(member(f_members, "f"), F.col("f").eqNullSafe(F.col("_f_like")))
    return found.select(F.col("_a").alias(area), F.col("_f").alias(footprint), "share")


def covered(areas: DataFrame, footprints: DataFrame, area: str, footprint: str, least: float, points: str = "points") -> DataFrame:
    """The footprints, with all their columns, that cover at least the share ``least`` of an area, by area and with the share.

    A share that is the limit itself counts: it comes out of sums that may miss it by rounding (NEAR).
    """
    share = coverage(areas, footprints, area, footprint, points).where(F.col("share") >= least - NEAR)
    return share.join(footprints, footprint)


def grid_cells(areas: DataFrame, key: str, points: str = "points", per_degree: int = 10) -> DataFrame:
    """(key, i, j, by_box): grid centres at lat i / per_degree, lon j / per_degree strictly inside each area.

    Scan lines: where a row of centres crosses an area's sides is worked out once a row; between each two crossings lies a
    run of centres. An area without a centre inside gets those of its box, edges included (by_box).
    """
    n = float(per_degree)
    p = F.col("_p")
    rest = F.concat(F.slice(p, F.lit(2), F.size(p)), F.slice(p, 1, 1))
    sides = F.transform(F.arrays_zip(p.alias("a"), rest.alias("b")), lambda e: F.struct(e["a"]["lon"].alias("x0"), e["a"]["lat"].alias("y0"), e["b"]["lon"].alias("x1"), e["b"]["lat"].alias("y1")))
    box = points_box(p)
    given = areas.where(F.size(points) > 0).select(F.col(key).alias("_key"), F.col(points).alias("_p")).select("_key", sides.alias("_s"), box.alias("_b"))
    whole = lambda c: c.cast("long")
    low = lambda c: whole(F.ceil(c * n))
    high = lambda c: whole(F.floor(c * n))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    rows = given.select("_key", "_s", F.explode(span(low(F.col("_b.south")), high(F.col("_b.north")))).alias("i"))
    y = F.col("i") / n
    cut = F.filter("_s", lambda e: (e["y0"] > y) != (e["y1"] > y))
    xs = F.array_sort(F.transform(cut, lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])))
    flat = F.filter("_s", lambda e: (e["y0"] == y) & (e["y1"] == y))  # a side that lies along the row
    lines = rows.select("_key", "i", xs.alias("_x"), flat.alias("_flat")).where(F.size("_x") > 0)

    def first_after(x: Column) -> Column:
        f = whole(F.floor(x * n))
        return F.when(f / n > x, f).when((f + 1) / n > x, f + 1).otherwise(f + 2)

    def last_before(x: Column) -> Column:
        f = whole(F.ceil(x * n))
        return F.when(f / n < x, f).when((f - 1) / n < x, f - 1).otherwise(f - 2)

    runs = F.transform(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda k: span(first_after(F.col("_x")[k]), last_before(F.col("_x")[k + 1])))
    inside = lines.select("_key", "i", "_flat", F.explode(F.flatten(runs)).alias("j"))
    x = F.col("j") / n
    inside = inside.where(~F.exists("_flat", lambda e: x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])))).select("_key", "i", "j")
    none = given.join(inside.select("_key").distinct(), "_key", "left_anti").select("_key", "_b")
    box_rows = none.select("_key", "_b", F.explode(span(low(F.col("_b.south")), high(F.col("_b.north")))).alias("i"))
    in_box = box_rows.select("_key", "i", F.explode(span(low(F.col("_b.west")), high(F.col("_b.east")))).alias("j"))
    return inside.withColumn("by_box", F.lit(False)).unionByName(in_box.withColumn("by_box", F.lit(True))).select(F.col("_key").alias(key), "i", "j", "by_box")


def area_cell_means(grid: DataFrame, cells: DataFrame, key: str, per_degree: int = 10) -> DataFrame:
    """(key, time, one column a variable): means over each area's cells of a grid (time, lat, lon, variables), nulls left out."""
    values = [c for c in grid.columns if c not in ("time", "lat", "lon", "year", "month")]
    at = grid.select("time", F.round(F.col("lat") * per_degree).cast("long").alias("i"), F.round(F.col("lon") * per_degree).cast("long").alias("j"), *values)
    # a cell's values of a time are added up before the areas meet it, and means are formed once for areas of the same cells
    at = at.groupBy("time", "i", "j").agg(*(f(c).alias(f"{p}_{c}") for c in values for f, p in ((F.sum, "s"), (F.count, "n"))))
    members, classes = alike(cells.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_cells")), "_key", "_cells")
    own = classes.select("like", F.inline("_cells"))
    mean = lambda c: (F.sum(f"s_{c}") / F.sum(f"n_{c}")).alias(c)
    means = at.join(own.hint("merge"), ["i", "j"]).groupBy("like", "time").agg(*map(mean, values))
    found = means.join(members.withColumnRenamed("like", "_like").hint("merge"), F.col("like").eqNullSafe(F.col("_like")))
    return found.select(F.col("_key").alias(key), "time", *values)
