"""Column functions over scene names, platforms, dates and group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_date(name: Column) -> Column:
    """yyyyMMdd of a bare date, of the first _yyyyMMddThhmmss_ part, or of characters 18 to 25 of a long name; else ''."""
    stamp = F.regexp_extract(name, r"_(\d{8})T\d{6}", 1)
    late = F.substring(name, 18, 8)
    return F.when(name.rlike(r"^\d{8}$"), name).when(stamp != "", stamp).when((F.length(name) > 25) & late.rlike(r"^\d{8}$"), late).otherwise("")


def scene_hour(name: Column) -> Column:
    """UTC hour of the first time stamp; null for bare dates."""
    return F.regexp_extract(name, r"\d{8}T(\d{2})\d{4}", 1).try_cast("int")


def start_stamp(name: Column) -> Column:
    """The first yyyyMMddThhmmss of a name; '' without one."""
    return F.regexp_extract(name, r"(\d{8}T\d{6})", 1)


def normal_date(value: Column) -> Column:
    """yyyyMMdd of a scene name or of an ISO date."""
    own = scene_date(value)
    return F.when(own != "", own).otherwise(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 8))


def swath_of(name: Column) -> Column:
    """The IWn or EWn part of a name; null without one."""
    return F.get(F.filter(F.split(name, "_"), lambda x: x.rlike(r"^(IW|EW)\d$")), F.lit(0))


def burst_position(name: Column) -> Column:
    """<id>_<swath>: the part before the swath, and the swath."""
    parts = F.split(name, "_")
    at = F.array_position(parts, swath_of(name)).cast("int")
    return F.when(at > 1, F.concat_ws("_", F.get(parts, at - 2), F.get(parts, at - 1)))


def path_of(path: Column, orbit: Column, burst: Column) -> Column:
    """Track number: the path, else the relative orbit, else the digits at the head of the burst id."""
    return F.coalesce(path, orbit, F.regexp_extract(burst, r"^(\d+)_", 1).try_cast("long"))


def full_burst_id(track: Column, burst: Column, swath: Column) -> Column:
    return F.format_string("%03d_%d_%s", track.cast("int"), burst.cast("int"), F.upper(swath))


# The property that names the frame, by dataset and by what a platform's name holds.
FRAME_OF_DATASET = {"SENTINEL-1": "frameNumber", "ALOS": "frameNumber", "NISAR": "frameID", "BURST": "burstID"}
FRAME_OF_PLATFORM = {"SENTINEL": "frameNumber", "ALOS": "frameNumber", "NISAR": "frameID"}


def frame_key(dataset: Column, platform: Column, by_burst: Column, by_frame: Column) -> Column:
    """Name of the property that groups scenes beside the path.

    A search by burst ids groups by burst, one by frames by the frame number; else the dataset decides, then the
    platform, and in the end the frame number.
    """
    known = F.lit(None).cast("string")
    for name, key in FRAME_OF_DATASET.items():
        known = F.when(F.upper(dataset) == name, key).otherwise(known)
    part = F.lit(None).cast("string")
    for name, key in reversed(FRAME_OF_PLATFORM.items()):
        part = F.when(F.upper(platform).contains(name), key).otherwise(part)
    return F.when(by_burst, "burstID").when(by_frame, "frameNumber").otherwise(F.coalesce(known, part, F.lit("frameNumber")))


def group_key(properties: Column, key: Column) -> Column:
    """struct<path, frame> of a scene's properties (a map of strings)."""
    return F.struct(properties["pathNumber"].alias("path"), properties[key].alias("frame"))


def merge_tag(frames: Column) -> Column:
    """merged_f1_f2 of the sorted distinct frames of an array."""
    return F.concat(F.lit("merged_"), F.array_join(F.transform(F.array_sort(F.array_distinct(frames)), lambda f: F.concat(F.lit("f"), f)), "_"))


def end_of_day(value: Column) -> Column:
    """A bare date gets T23:59:59; times, '' and null stay."""
    return F.when((value != "") & ~value.contains("T") & ~value.contains(":"), F.concat(value, F.lit("T23:59:59"))).otherwise(value)


def mission(platform: Column) -> Column:
    up = F.upper(platform)
    out = F.lit(None).cast("string")
    for m in ("1D", "1C", "1B", "1A"):
        out = F.when(up.contains(m), f"S{m}").otherwise(out)
    return out


def round_hour(hhmmss: Column) -> Column:
    """The hour, rounded up beyond half past; 24 becomes 0 of the same day."""
    h, m = F.substring(hhmmss, 1, 2).cast("int"), F.substring(hhmmss, 3, 2).cast("int")
    s = F.substring(hhmmss, 5, 2).cast("int")
    return F.pmod(h + (m * 60 + s > 1800).cast("int"), F.lit(24))


def tile_lat(lat: Column, step: int = 1) -> Column:
    t = (F.floor(lat / step) * step).cast("int")
    return F.concat(F.when(t >= 0, "N").otherwise("S"), F.lpad(F.abs(t).cast("string"), 2, "0"))


def tile_lon(lon: Column, step: int = 1) -> Column:
    t = (F.floor(lon / step) * step).cast("int")
    return F.concat(F.when(t >= 0, "E").otherwise("W"), F.lpad(F.abs(t).cast("string"), 3, "0"))


def pair_key(ref: Column, sec: Column, d_ref: Column, d_sec: Column) -> Column:
    """ref:sec with the earlier date first."""
    return F.when(d_ref <= d_sec, F.concat_ws(":", ref, sec)).otherwise(F.concat_ws(":", sec, ref))


def composite_code(day: Column) -> Column:
    """AyyyyDDD"""
    return F.concat(F.lit("A"), F.date_format(day, "yyyyDDD"))


def composite_day(code: Column) -> Column:
    """The date of AyyyyDDD."""
    return F.date_add(F.make_date(F.substring(code, 2, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(code, 6, 3).cast("int") - 1)


def day_offset_id(day: Column) -> Column:
    """yyyyNNN with the days since January 1 (January 8 is 007)."""
    return F.concat(F.year(day).cast("string"), F.lpad((F.dayofyear(day) - 1).cast("string"), 3, "0"))


def ionosphere_day(name: Column) -> Column:
    """Date of an ionosphere file: ....DDD0.YYi before the long names, ...._yyyyDDD.... since."""
    doy, yy = F.regexp_extract(name, r"(?i)(\d{3})0\.(\d{2})i", 1), F.regexp_extract(name, r"(?i)(\d{3})0\.(\d{2})i", 2)
    long = F.regexp_extract(name, r"_(\d{7})\d{4}_", 1)
    year = F.when(yy.try_cast("int") < 80, 2000 + yy.try_cast("int")).otherwise(1900 + yy.try_cast("int"))
    old = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.try_cast("int") - 1)
    new = F.date_add(F.make_date(F.substring(long, 1, 4).try_cast("int"), F.lit(1), F.lit(1)), F.substring(long, 5, 3).try_cast("int") - 1)
    return F.when(long != "", new).when(doy != "", old)
