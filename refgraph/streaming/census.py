"""A4 as a stream: the first sighting of each (file, name) in an append-only folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "f string, q string, l int, t long"


def read(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Census rows; malformed lines (such as a last one cut off) are dropped."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    return rows.where("f is not null and q is not null and t is not null")


def first_seen(rows: DataFrame) -> DataFrame:
    """(f, name, l, t) with the least t; the name is what follows the last dot. Batch, or stream in update mode."""
    named = rows.withColumn("name", F.regexp_extract("q", r"([^.]+)$", 1))
    return named.groupBy("f", "name").agg(F.min_by("l", F.struct("t", "l")).alias("l"), F.min("t").alias("t"))


def new_sightings(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Stream of sightings whose (f, q) wasn't seen within the watermark: state stays bounded, absence never demotes."""
    timed = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(["f", "q"])


def active(rows: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(begin, f, sightings) in tumbling windows; late rows within the watermark still count."""
    timed = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window).alias("w"), "f").agg(F.count(F.lit(1)).alias("sightings")).select(F.col("w.start").alias("begin"), "f", "sightings")
