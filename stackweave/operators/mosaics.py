"""Layers on grids of their own: integer offsets between grids, mosaics over them, crops to an area.

A grid table has a row a layer: layer, x0, y0 (upper left corner), dx, dy (dy negative), n_rows, n_cols.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coordinates by which postings may differ and count as the same.
SAME = 1e-6
Box = tuple[float, float, float, float]


def frame(grids: DataFrame, area: Box | None = None) -> DataFrame:
    """One row (left, top, step_x, step_y, n_cols, n_rows): the union of all grids, within the area's box (west, south, east,
    north) if one is given. Grids of unlike posting, or a frame without a cell, are an error when it is read."""
    right, bottom = F.col("x0") + F.col("dx") * F.col("n_cols"), F.col("y0") + F.col("dy") * F.col("n_rows")
    whole = grids.agg(
        *(f(c).alias(f"{n}_{c}") for c in ("dx", "dy") for n, f in (("least", F.min), ("most", F.max))),
        F.min("x0").alias("left"), F.max("y0").alias("top"), F.max(right).alias("right"), F.min(bottom).alias("bottom"),
    ).where("left IS NOT NULL")
    if area is not None:
        west, south, east, north = map(float, area)
        whole = whole.withColumns({"left": F.greatest("left", F.lit(west)), "right": F.least("right", F.lit(east)), "top": F.least("top", F.lit(north)), "bottom": F.greatest("bottom", F.lit(south))})
    unlike = (F.col("most_dx") - F.col("least_dx") > SAME) | (F.col("most_dy") - F.col("least_dy") > SAME)
    step = lambda c: F.when(unlike, F.raise_error(F.lit(f"grids of unlike posting {c}")).cast("double")).otherwise(F.abs(F.col(f"least_{c}")))
    n = lambda a, b, c: F.round((F.col(a) - F.col(b)) / F.col(c)).cast("long")
    sized = whole.select("left", "top", "right", "bottom", step("dx").alias("step_x"), step("dy").alias("step_y")).select("left", "top", "step_x", "step_y", n("right", "left", "step_x").alias("n_cols"), n("top", "bottom", "step_y").alias("n_rows"))
    empty = F.raise_error(F.lit("no cell of the grids lies in the area")).cast("long")
    return sized.withColumn("n_cols", F.when((F.col("n_cols") <= 0) | (F.col("n_rows") <= 0), empty).otherwise(F.col("n_cols")))


def on_frame(pixels: DataFrame, grids: DataFrame, area: Box | None = None) -> DataFrame:
    """pixels with row and col in the frame, by whole cells from each layer's own origin; what lies outside goes."""
    f = F.broadcast(frame(grids, area))  # one row
    shift = lambda a, b, c: F.round((F.col(a) - F.col(b)) / F.col(c)).cast("long")
    own = grids.select("layer", "x0", "y0").crossJoin(f).select("layer", shift("x0", "left", "step_x").alias("_c"), shift("top", "y0", "step_y").alias("_r"), F.col("n_cols").alias("_w"), F.col("n_rows").alias("_h"))
    moved = pixels.join(own, "layer").withColumns({"row": F.col("row") + F.col("_r"), "col": F.col("col") + F.col("_c")})
    return moved.where("row >= 0 AND row < _h AND col >= 0 AND col < _w").drop("_c", "_r", "_w", "_h")


def finite(*columns: str) -> Column:
    """All are numbers and finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    out = ok(columns[0])
    for c in columns[1:]:
        out = out & ok(c)
    return out


def first_valid(pixels: DataFrame, grids: DataFrame, values: Sequence[str], area: Box | None = None) -> DataFrame:
    """(row, col, values, layer): at each cell of the frame the values of the first layer that is valid there.

    A pixel is valid if all its values are finite and not all are 0: (re, im) for complex layers, one value for real ones.
    The choice is an aggregate over plain numbers, combined before its shuffle; no layer is gathered.
    """
    some = F.lit(False)
    for v in values:
        some = some | (F.col(v) != 0)
    placed = on_frame(pixels.where(finite(*values) & some), grids, area)
    return placed.groupBy("row", "col").agg(*(F.min_by(v, "layer").alias(v) for v in values), F.min("layer").alias("layer"))


def windows(grids: DataFrame, box: Box, buffer: float = 0.0, common: bool = False) -> DataFrame:
    """(layer, row0, row1, col0, col1, x0, y0): each layer's cells that meet the box widened by ``buffer``; ends exclusive.

    Layers without a cell there are left out. With ``common`` all windows are cut to what the layers left share.
    """
    west, south, east, north = box[0] - buffer, box[1] - buffer, box[2] + buffer, box[3] + buffer
    x, y = F.col("dx"), F.abs("dy")
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.col(n), c)).cast("long")
    met = grids.select(
        "layer", "x0", "y0", "dx", "dy",
        clamp(F.floor((F.col("y0") - north) / y), "n_rows").alias("row0"), clamp(F.ceil((F.col("y0") - south) / y), "n_rows").alias("row1"),
        clamp(F.floor((west - F.col("x0")) / x), "n_cols").alias("col0"), clamp(F.ceil((east - F.col("x0")) / x), "n_cols").alias("col1"),
    ).where("row0 < row1 AND col0 < col1")
    if common:
        edge = lambda o, s, c: F.col(o) + F.col(s) * F.col(c)
        shared = met.agg(F.max(edge("x0", "dx", "col0")).alias("_w"), F.min(edge("x0", "dx", "col1")).alias("_e"), F.min(edge("y0", "dy", "row0")).alias("_n"), F.max(edge("y0", "dy", "row1")).alias("_s"))
        at = lambda a, b, s: F.round((F.col(a) - F.col(b)) / s).cast("long")
        met = met.crossJoin(F.broadcast(shared)).withColumns({"row0": at("y0", "_n", y), "row1": at("y0", "_s", y), "col0": at("_w", "x0", x), "col1": at("_e", "x0", x)}).where("row0 < row1 AND col0 < col1")
    return met.select("layer", "row0", "row1", "col0", "col1", edge_of("x0", "dx", "col0"), edge_of("y0", "dy", "row0"))


def edge_of(origin: str, step: str, index: str) -> Column:
    return (F.col(origin) + F.col(step) * F.col(index)).alias(origin)


def crop(pixels: DataFrame, grids: DataFrame, box: Box, buffer: float = 0.0, common: bool = False) -> DataFrame:
    """pixels of the layers that meet the box, with row and col from their window's corner."""
    w = windows(grids, box, buffer, common).drop("x0", "y0")
    inside = pixels.join(w, "layer").where("row >= row0 AND row < row1 AND col >= col0 AND col < col1")
    return inside.withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}).drop("row0", "row1", "col0", "col1")
