"""Landed feed files as a stream of postings, and sightings counted per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.schemas import LANDED_FEED
from postlane.sources.feeds import normalize_all


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Payload files of all sources (JSON lines below ``path/source=<name>``) as they land.

    The folders are partitions of one stream: a source may appear later, and a folder of an
    unknown source costs a filter.
    """
    return spark.readStream.schema(LANDED_FEED).option("maxFilesPerTrigger", files_per_trigger).json(path)


def posting_stream(spark: SparkSession, path: str, sources: list[str]) -> DataFrame:
    """Postings of the configured sources, by the same normalizers as in batch.

    One stream and one plan for all of them. Unknown names are skipped.
    """
    return normalize_all(landed_stream(spark, path), sources)


def sightings_per_day(sightings: DataFrame, ts: Column, delay: str = "1 day") -> DataFrame:
    """Sightings per source and day of ``ts``; rows later than ``delay`` are dropped.

    Works on a stream (append mode emits a day once it is complete) and on a table.
    """
    stamped = sightings.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", delay)
    return (
        stamped.groupBy(F.window("_ts", "1 day").alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
    )
