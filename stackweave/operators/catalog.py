"""Operators over the scene catalogue: filters, groups, summaries, limits. All are DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_overlap


def filter_scenes(scenes: DataFrame, *, start: str | None = None, end: str | None = None, paths: Sequence[int] | None = None, frames: Sequence[str] | None = None, orbits: Sequence[int] | None = None, months: Sequence[int] | None = None, polarizations: Sequence[str] | None = None, stacks: Sequence[tuple[int, str]] | None = None) -> DataFrame:
    """Optional predicates, all of which must hold; dates are days, ends included. They reach the scan as filters."""
    terms: list[Column] = []
    if start:
        terms.append(F.col("day") >= F.lit(start).cast("date"))
    if end:
        terms.append(F.col("day") <= F.lit(end).cast("date"))
    for column, values in (("path", paths), ("frame", frames), ("orbit", orbits)):
        if values is not None:
            terms.append(F.col(column).isin(list(values)))
    if months is not None:
        terms.append(F.month("day").isin(list(months)))
    if polarizations is not None:
        terms.append(F.arrays_overlap(F.split("polarization", r"[+ ]"), F.array(*map(F.lit, polarizations))))
    if stacks is not None:
        terms.append(reduce(lambda a, b: a | b, [(F.col("path") == p) & (F.col("frame") == f) for p, f in stacks], F.lit(False)))
    return scenes.where(reduce(lambda a, b: a & b, terms)) if terms else scenes


def filter_stacks(
    scenes: DataFrame, *,
    stacks: Sequence[tuple[int, str]] | None = None, start: str | None = None, end: str | None = None, frames: Sequence | None = None, asf_frames: Sequence | None = None,
    direction: str | None = None, look: str | None = None, beam: str | None = None, level: str | None = None,
    orbits: Sequence[int] | None = None, absolute_orbits: Sequence[int] | None = None, polarizations: Sequence[str] | None = None, months: Sequence[int] | None = None,
    min_coverage: float | None = None, aoi: tuple[float, float, float, float] | None = None,
    earliest: int | None = None, latest: int | None = None, most: int | None = None, min_count: int | None = None,
) -> DataFrame:
    """All eighteen predicates, each optional, in their order: what the first item of a stack decides, then its scenes'
    own values, then the share of the area (west, south, east, north) that a scene's box covers, then the first, else the
    last, else at most so many scenes of a stack, and in the end the number of those left.
    """
    wanted = {c: v for c, v in (("direction", direction), ("look", look), ("beam", beam), ("level", level)) if v}
    out = scenes
    if wanted:
        first = scenes.groupBy("stack").agg(F.min_by(F.struct(*wanted), F.struct("t", "scene")).alias("_first"))
        same = reduce(lambda a, b: a & b, [F.upper(F.col(f"_first.{c}")) == v.upper() for c, v in wanted.items()])
        out = out.join(first.where(same).select("stack"), "stack", "left_semi")
    out = filter_scenes(out, start=start, end=end, frames=frames, orbits=orbits, months=months, polarizations=polarizations, stacks=stacks)
    for column, values in (("asf_frame", asf_frames), ("absolute_orbit", absolute_orbits)):
        if values is not None:
            out = out.where(F.col(column).isin(list(values)))
    if min_coverage is not None:
        out = out.where(box_overlap(*(F.lit(float(x)) for x in aoi), *(F.col(c) for c in ("west", "south", "east", "north"))) >= min_coverage)
    return limit_per_stack(out, earliest, latest, most, min_count)


def search(scenes: DataFrame, aoi: tuple[float, float, float, float] | None = None, **predicates) -> DataFrame:
    """filter_scenes() within an area (west, south, east, north) that a scene's box touches; no scene is an error."""
    if aoi is not None:
        west, south, east, north = aoi
        scenes = scenes.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return not_empty(filter_scenes(scenes, **predicates), "no scene matches the search")


def not_empty(rows: DataFrame, message: str) -> DataFrame:
    """rows; an error if there are none. Reads until the first row."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def by_first_item(scenes: DataFrame, column: str, value: str) -> DataFrame:
    """Stacks whose earliest scene has the value, whatever the case."""
    first = scenes.groupBy("stack").agg(F.min_by(column, F.struct("t", "scene")).alias("_first"))
    keep = first.where(F.upper("_first") == value.upper()).select("stack")
    return scenes.join(keep, "stack", "left_semi")


def collapse_by_date(scenes: DataFrame, key: str = "stack") -> DataFrame:
    """The earliest scene of each stack and day (ties: the smallest id).

    Spark limits the groups before the shuffle, and columns that nobody uses are not carried along.
    """
    first = F.row_number().over(Window.partitionBy(key, "day").orderBy("t", "scene"))
    return scenes.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def limit_per_stack(scenes: DataFrame, first: int | None = None, last: int | None = None, cap: int | None = None, min_count: int | None = None) -> DataFrame:
    """The first, else the last, else at most cap scenes of each stack; then stacks under min_count go."""
    n = first or last or cap
    out = scenes
    if n:
        order = [F.col("t").desc(), F.col("scene").desc()] if last and not first else ["t", "scene"]
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("stack").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    if min_count:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("stack"))).where(F.col("_n") >= min_count).drop("_n")
    return out


def stack_summary(scenes: DataFrame) -> DataFrame:
    """Scenes, dates and platforms of each stack and direction."""
    return scenes.groupBy("path", "frame", "direction").agg(
        F.count("*").alias("n_scenes"),
        F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"),
        F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"),
    )


def burst_consistency(scenes: DataFrame, group: str, date: str, position: str) -> DataFrame:
    """Per group and date the positions that other dates of the group have and this one lacks."""
    have = scenes.groupBy(group, date).agg(F.collect_set(position).alias("have"))
    every = scenes.groupBy(group).agg(F.collect_set(position).alias("every"))
    missing = F.array_sort(F.array_except("every", "have"))
    return have.join(every, group).select(group, date, F.size("have").cast("long").alias("n_have"), F.array_join(missing, ",").alias("missing"))


def search_by_name(scenes: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found scenes, first of each name; names not found). Extensions are cut, metadata levels left out."""
    wanted = names.select(F.regexp_replace("name", r"\.(zip|SAFE|h5|tiff?)$", "").alias("name")).distinct()
    usable = scenes.where(~F.col("level").startswith("METADATA"))
    first = usable.groupBy("name").agg(F.min("scene").alias("scene"))
    return first.join(wanted, "name", "left_semi"), wanted.join(usable, "name", "left_anti")


def name_list(texts: DataFrame, column: str = "text") -> DataFrame:
    """Granule names in whitespace- or comma-separated texts, with the first place of each; # starts a comment line.

    The place counts the tokens of a text outside comments.
    """
    lines = F.filter(F.split(column, r"\n"), lambda x: ~F.ltrim(x).startswith("#"))
    token = F.posexplode(F.split(F.array_join(lines, "\n"), r"[\s,]+")).alias("pos", "name")
    found = texts.select("doc_id", token).where(F.col("name").rlike(r"^[A-Za-z0-9][A-Za-z0-9_\-]{19,}$"))
    return found.groupBy("name").agg(F.min(F.struct("doc_id", "pos")).alias("_p")).select("name", F.col("_p.doc_id").alias("doc_id"), F.col("_p.pos").cast("long").alias("pos"))


def in_common(rows: DataFrame, group: str, unit: str, item: str) -> DataFrame:
    """Items of each group that all its units have."""
    units = rows.groupBy(group).agg(F.countDistinct(unit).alias("n_units"))
    each = rows.groupBy(group, item).agg(F.countDistinct(unit).alias("n_have"))
    return each.join(units, group).where("n_have = n_units").select(group, item)


def missing_items(rows: DataFrame, group: str, unit: str, item: str) -> DataFrame:
    """(group, unit, item): items that another unit of the group has and this one lacks."""
    each = rows.select(group, unit, item).distinct()
    units = each.select(group, unit).distinct()
    return each.select(group, item).distinct().join(units, group).join(each, [group, unit, item], "left_anti").select(group, unit, item)
