"""A store of features by section and key that is written in place, bucket by bucket.

Rows are (section, key, value, fetched): fetched is the day of the fetch, null in sections that never expire. A table lies
in folders of section and bucket. A write touches only the buckets of its keys: these are read, merged and put in place
of the old ones when the whole write is done, so that one that fails leaves the old rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days after which rows of a section expire; other sections never do.
AGES = {"geometry": 365, "landcover": 365}
BUCKETS = 16
ROWS = "section string, key string, value string, fetched int"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, with their bucket; none if nothing was written yet."""
    kind = f"{ROWS}, bucket int"
    return spark.read.schema(kind).parquet(path) if exists(spark, path) else spark.createDataFrame([], kind)


def put(new: DataFrame, path: str, now: int, ages: dict[str, int] = AGES, buckets: int = BUCKETS) -> None:
    """Write rows (section, key, value, maybe fetched) over those of the same section and key.

    Rows of an expiring section without a day get ``now``. Rows without a value, a section or a key are left out. Of new
    rows of one key that with the latest day counts (ties: the largest value).
    """
    spark = new.sparkSession
    day = F.coalesce(F.col("fetched").cast("int"), F.lit(now)) if "fetched" in new.columns else F.lit(now)
    stamped = new.where("section IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL").select("section", "key", "value", F.when(F.col("section").isin(*ages), day).cast("int").alias("fetched"))
    latest = stamped.groupBy("section", "key").agg(F.max(F.struct("fetched", "value")).alias("r")).select("section", "key", "r.value", "r.fetched", bucket(F.col("key"), buckets).alias("bucket"))
    if not exists(spark, path):
        old = spark.createDataFrame([], latest.schema)
    else:
        touched = latest.select("section", "bucket").distinct()
        old = rows(spark, path).join(touched, ["section", "bucket"], "left_semi").join(latest.select("section", "key"), ["section", "key"], "left_anti").select(*latest.columns)
    merged = old.unionByName(latest).repartition("section", "bucket").sortWithinPartitions("section", "bucket", "key")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section", "bucket").parquet(path)


def get(spark: SparkSession, path: str, wanted: DataFrame, now: int, ages: dict[str, int] = AGES, refresh: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(section, key, value): what is stored of the wanted (section, key) and has not expired; null where it must be fetched.

    With refresh nothing stored counts. A row of an expiring section without a day counts as expired.
    """
    want = wanted.select("section", "key").distinct().withColumn("bucket", bucket(F.col("key"), buckets))
    expired = F.lit(False)
    for section, age in ages.items():
        expired = expired | ((F.col("section") == section) & F.coalesce(F.lit(now) - F.col("fetched") > age, F.lit(True)))
    held = rows(spark, path).where(~expired & F.lit(not refresh)).select("section", "bucket", "key", "value")
    return want.join(held, ["section", "bucket", "key"], "left").select("section", "key", "value")


def seed(prefetched: DataFrame, path: str, now: int) -> None:
    """Put in what another step fetched: (section, lat, lon, day, value), under its key of place and day."""
    key = F.format_string("%.3f:%.3f:%s", F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("day").cast("string"))
    put(prefetched.select("section", key.alias("key"), "value"), path, now)
