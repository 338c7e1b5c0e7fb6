"""XML sources: orbit state vectors, annotations, manifests; by Spark's XML reader or from text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORBIT_SCHEMA = "UTC string, X struct<_VALUE: double, _unit: string>, Y struct<_VALUE: double, _unit: string>, Z struct<_VALUE: double, _unit: string>, VX struct<_VALUE: double, _unit: string>, VY struct<_VALUE: double, _unit: string>, VZ struct<_VALUE: double, _unit: string>"


def utc_seconds(text: Column) -> Column:
    """Seconds of an ISO time, with or without the prefix UTC=; a time without a zone is UTC."""
    return F.unix_micros(F.to_timestamp(F.regexp_replace(text, "^UTC=", ""))) / 1e6


def orbit_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, x, y, z, vx, vy, vz) of the OSV elements of orbit files."""
    osv = spark.read.format("xml").option("rowTag", "OSV").schema(ORBIT_SCHEMA).load(path)
    axes = [F.col(f"{a}._VALUE").alias(a.lower()) for a in ("X", "Y", "Z", "VX", "VY", "VZ")]
    return osv.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), utc_seconds(F.col("UTC")).alias("t"), *axes)


def annotation_orbits(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, x, y, z) of the orbit elements of product annotations."""
    schema = "time string, position struct<x: double, y: double, z: double>"
    rows = spark.read.format("xml").option("rowTag", "orbit").schema(schema).load(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), utc_seconds(F.col("time")).alias("t"), "position.x", "position.y", "position.z")


def annotation_centres(spark: SparkSession, path: str) -> DataFrame:
    """(file, lat, lon): mean of the geolocation grid."""
    rows = spark.read.format("xml").option("rowTag", "geolocationGridPoint").schema("latitude double, longitude double").load(path)
    return rows.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file")).agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))


def preferred_annotation(files: DataFrame) -> DataFrame:
    """Of each product (product, path) the annotation to read: the second swath's first; calibration files never."""
    usable = files.where(~F.lower("path").rlike("calibration|noise|rfi"))
    return usable.groupBy("product").agg(F.min_by("path", F.struct(~F.lower("path").contains("iw2"), "path")).alias("path"))


def footprint(manifest: Column) -> Column:
    """array<struct<lon, lat>> of the coordinates text "lat,lon lat,lon ..." in a manifest."""
    text = F.regexp_extract(manifest, r"<gml:coordinates>([^<]*)</gml:coordinates>", 1)
    pair = lambda p: F.struct(F.get(F.split(p, ","), F.lit(1)).cast("double").alias("lon"), F.get(F.split(p, ","), F.lit(0)).cast("double").alias("lat"))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p.contains(",")), pair)


AXES = ("X", "Y", "Z", "VX", "VY", "VZ")
ORBIT_FILE = "Data_Block struct<List_of_OSVs: struct<OSV: array<struct<UTC: string, " + ", ".join(f"{a}: struct<_VALUE: double, _unit: string>" for a in AXES) + ">>>>"
ANNOTATION = "generalAnnotation struct<orbitList: struct<orbit: array<struct<time: string, position: struct<x: double, y: double, z: double>, velocity: struct<x: double, y: double, z: double>>>>>, adsHeader struct<startTime: string, stopTime: string>, geolocationGrid struct<geolocationGridPointList: struct<geolocationGridPoint: array<struct<latitude: double, longitude: double>>>>"


def vectors_of_orbits(documents: DataFrame, text: str = "document") -> DataFrame:
    """documents' other columns and (t, x, y, z, vx, vy, vz): the state vectors in a column of orbit documents.

    A document that is null or not XML has no rows.
    """
    others = [c for c in documents.columns if c != text]
    osv = documents.select(*others, F.from_xml(text, ORBIT_FILE).alias("_d")).select(*others, F.explode("_d.Data_Block.List_of_OSVs.OSV").alias("_v"))
    return osv.select(*others, utc_seconds(F.col("_v.UTC")).alias("t"), *(F.col(f"_v.{a}._VALUE").alias(a.lower()) for a in AXES))


def parts_of_annotations(documents: DataFrame, text: str = "document") -> DataFrame:
    """documents' other columns, orbit (array<struct<t, x, y, z, vx, vy, vz>>), centre_time (seconds), lat, lon.

    centre_time is half way between start and stop; lat and lon are means of the geolocation grid.
    """
    others = [c for c in documents.columns if c != text]
    d = documents.select(*others, F.from_xml(text, ANNOTATION).alias("_d"))
    vector = lambda v: F.struct(utc_seconds(v["time"]).alias("t"), *(v["position"][k].alias(k) for k in "xyz"), *(v["velocity"][k].alias(f"v{k}") for k in "xyz"))
    points = F.col("_d.geolocationGrid.geolocationGridPointList.geolocationGridPoint")
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    start, stop = (utc_seconds(F.col(f"_d.adsHeader.{k}")) for k in ("startTime", "stopTime"))
    return d.select(*others, F.transform("_d.generalAnnotation.orbitList.orbit", vector).alias("orbit"), ((start + stop) / 2).alias("centre_time"), mean("latitude").alias("lat"), mean("longitude").alias("lon"))


def orbit_document(vectors: Column) -> Column:
    """The orbit document of an array<struct<utc, x, y, z, vx, vy, vz>>."""
    axis = lambda v, a: F.concat(F.lit(f'<{a} unit="m{"/s" if len(a) > 1 else ""}">'), v[a.lower()].cast("string"), F.lit(f"</{a}>"))
    one = lambda v: F.concat(F.lit("<OSV><UTC>UTC="), v["utc"], F.lit("</UTC>"), *(axis(v, a) for a in AXES), F.lit("</OSV>"))
    return F.concat(F.lit("<Earth_Explorer_File><Data_Block><List_of_OSVs>"), F.array_join(F.transform(vectors, one), ""), F.lit("</List_of_OSVs></Data_Block></Earth_Explorer_File>"))
