"""Pixel tables (layer, row, col, value): windows, mosaics, masks, statistics, neighbourhoods, complex products.

Neighbourhood operators add up values that each pixel sends to its neighbours, or use windows along rows and columns
of bounded length, so that no task holds a whole layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crop(pixels: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    return pixels.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))


def extents(pixels: DataFrame, key: str = "layer") -> DataFrame:
    return pixels.groupBy(key).agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def common_overlap(ext: DataFrame) -> DataFrame:
    return ext.agg(F.max("row0").alias("row0"), F.min("row1").alias("row1"), F.max("col0").alias("col0"), F.min("col1").alias("col1"))


def union_extent(ext: DataFrame) -> DataFrame:
    return ext.agg(F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.min("col0").alias("col0"), F.max("col1").alias("col1"))


def intersect_window(ext: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Each extent's part of the window; null where they don't meet."""
    a, b, c, d = F.greatest("row0", F.lit(row0)), F.least("row1", F.lit(row1)), F.greatest("col0", F.lit(col0)), F.least("col1", F.lit(col1))
    ok = (a <= b) & (c <= d)
    keep = [x for x in ext.columns if x not in ("row0", "row1", "col0", "col1")]
    return ext.select(*keep, *(F.when(ok, x).alias(n) for x, n in ((a, "row0"), (b, "row1"), (c, "col0"), (d, "col1"))))


def mosaic(pixels: DataFrame, order: str, valid: Column, keys=("row", "col")) -> DataFrame:
    """The first valid value of each output cell by ``order``; combined before the shuffle."""
    return pixels.where(valid).groupBy(*keys).agg(F.min_by("v", order).alias("v"), F.min(order).alias(order))


def multilook(pixels: DataFrame, down: int, across: int, layer: str = "layer") -> DataFrame:
    """Mean of blocks of down x across pixels; nulls are left out."""
    return pixels.groupBy(layer, F.floor(F.col("row") / down).alias("row"), F.floor(F.col("col") / across).alias("col")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def resampled(pixels: DataFrame, down: int, across: int, categorical: bool, layer: str = "layer") -> DataFrame:
    """Cells of down x across pixels: codes are taken from the pixel nearest to the centre (ties: first row, column), values averaged."""
    if not categorical:
        return multilook(pixels, down, across, layer)
    own = lambda c, n: F.abs(F.pmod(c, F.lit(n)) - (n - 1) / 2)
    far = own("row", down) ** 2 + own("col", across) ** 2
    return pixels.groupBy(layer, F.floor(F.col("row") / down).alias("row"), F.floor(F.col("col") / across).alias("col")).agg(F.min_by("v", F.struct(far, "row", "col")).alias("v"), F.count("v").alias("n"))


def nan_fraction(pixels: DataFrame, key: str = "layer") -> DataFrame:
    return pixels.groupBy(key).agg(F.avg(F.coalesce(F.isnan(F.col("v").cast("double")) | F.col("v").isNull(), F.lit(True)).cast("double")).alias("nan_fraction"))


def class_fractions(pixels: DataFrame, key: str, classes: dict[str, int]) -> DataFrame:
    """Shares of all pixels by class, and the class with most pixels (-1 without any; ties: the smaller code)."""
    each = pixels.groupBy(key, "cls").agg(F.count("*").alias("n"))
    known = F.col("cls").isin(list(classes.values()))
    return each.groupBy(key).agg(
        *(F.round(F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias(f"lc_{name}_fraction") for name, c in classes.items()),
        F.coalesce(F.max_by(F.when(known, F.col("cls")), F.when(known, F.struct("n", -F.col("cls")))), F.lit(-1)).cast("long").alias("dominant"),
    )


def gradients(pixels: DataFrame, spacing: float) -> DataFrame:
    """(layer, row, col, slope, aspect): central differences, one-sided at edges, in degrees."""
    def slope(axis: str, other: str) -> Column:
        w = Window.partitionBy("layer", other).orderBy(axis)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2) / spacing

    g = pixels.withColumn("gy", slope("row", "col")).withColumn("gx", slope("col", "row"))
    return g.select("layer", "row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))), F.lit(360.0)).alias("aspect"))


def box_sums(pixels: DataFrame, sums: list[str], half: int) -> DataFrame:
    """Sums of columns over (2 half + 1) squares: along rows, then along columns. A layer is a filled rectangle."""
    along = Window.partitionBy("layer", "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy("layer", "col").orderBy("row").rangeBetween(-half, half)
    step = pixels.select("layer", "row", "col", *(F.sum(c).over(along).alias(c) for c in sums))
    return step.select("layer", "row", "col", *(F.sum(c).over(down).alias(c) for c in sums))


def roughness(pixels: DataFrame) -> DataFrame:
    """Standard deviation over 3 x 3 pixels."""
    s = box_sums(pixels.withColumns({"s1": F.col("v"), "s2": F.col("v") * F.col("v"), "n": F.lit(1)}), ["s1", "s2", "n"], 1)
    var = F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2
    return s.select("layer", "row", "col", F.sqrt(F.greatest(F.lit(0.0), var)).alias("roughness"))


def complex_product(a_re: str, a_im: str, b_re: str, b_im: str) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return F.col(a_re) * F.col(b_re) + F.col(a_im) * F.col(b_im), F.col(a_im) * F.col(b_re) - F.col(a_re) * F.col(b_im)


def interferograms(slc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ref, sec, row, col, re, im, p_ref, p_sec): products of each pair's images on shared pixels."""
    side = lambda d, x: slc.select(F.col("layer").alias(d), "row", "col", F.col("re").alias(f"{x}_re"), F.col("im").alias(f"{x}_im"))
    both = pairs.join(side("ref", "a"), "ref").join(side("sec", "b"), ["sec", "row", "col"])
    re, im = complex_product("a_re", "a_im", "b_re", "b_im")
    return both.select("ref", "sec", "row", "col", re.alias("re"), im.alias("im"), (F.col("a_re") ** 2 + F.col("a_im") ** 2).alias("p_ref"), (F.col("b_re") ** 2 + F.col("b_im") ** 2).alias("p_sec"))


def coherence(ifg: DataFrame, half: int = 5) -> DataFrame:
    """Coherence of each pair over (2 half + 1) squares."""
    layers = ifg.withColumn("layer", F.struct("ref", "sec"))
    s = box_sums(layers, ["re", "im", "p_ref", "p_sec"], half)
    return s.select("layer.ref", "layer.sec", "row", "col", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.sqrt(F.col("p_ref") * F.col("p_sec"))).alias("coherence"))


def stack_mean(pixels: DataFrame, threshold: float) -> DataFrame:
    """Mean over layers, and the mean where it reaches the threshold (else null)."""
    m = pixels.groupBy("row", "col").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    return m.withColumn("masked", F.when(F.col("mean") >= threshold, F.col("mean")))


def display_range(pixels: DataFrame, key: str = "layer") -> DataFrame:
    """2nd and 98th percentile; least and most where these agree; and the 98th of the magnitude. Exact.

    Pixels are counted by value first, before the shuffle; what comes together is one row a distinct value.
    """
    counted = pixels.where("v IS NOT NULL").groupBy(key, "v").agg(F.count("*").alias("n"))
    r = counted.groupBy(key).agg(F.percentile("v", 0.02, F.col("n")).alias("p2"), F.percentile("v", 0.98, F.col("n")).alias("p98"), F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.percentile(F.abs("v"), 0.98, F.col("n")).alias("abs98"))
    flat = F.col("p2") >= F.col("p98")
    return r.select(key, F.when(flat, F.col("lo")).otherwise(F.col("p2")).alias("vmin"), F.when(flat, F.col("hi")).otherwise(F.col("p98")).alias("vmax"), "abs98")


def majority(fine: DataFrame, factor: int) -> DataFrame:
    """The most frequent class of each coarse cell (ties: the smallest)."""
    n = fine.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), "cls").agg(F.count("*").alias("n"))
    return n.groupBy("row", "col").agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("cls"), F.sum("n").alias("n"))


def water_mask(water: DataFrame) -> DataFrame:
    """1 where the source is 0 (land), 0 elsewhere."""
    return water.withColumn("valid", (F.col("v") == 0).cast("int"))


def decimated(pixels: DataFrame, n_rows: int, n_cols: int, most: int = 256) -> DataFrame:
    """At most ``most`` evenly spaced rows and columns."""
    step = max(1, -(-max(n_rows, n_cols) // most))
    return pixels.where((F.pmod("row", F.lit(step)) == 0) & (F.pmod("col", F.lit(step)) == 0))
