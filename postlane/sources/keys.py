"""Stored keys that small batches look up without reading all of them.

Keys lie in hash buckets, as partitions of the segments of a log. Every segment has a Bloom
filter per bucket beside its keys. A batch asks the filters first, by joins on places; only
keys that may be stored go on, and only the buckets of those keys are read. Nothing but the
numbers of these buckets, at most ``buckets`` of them, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.session import materialize
from postlane.sources.segments import DATA, Parts, SegmentLog, stamped

FILTER = "filter"
SCHEMAS = {
    DATA: "dedup_key string, entry long, bucket int",
    FILTER: "slots long, slot long, bits binary, bucket int",
}
# Places per key, bits per key, and bits in one stored bitmap (fixed by Spark's function).
PLACES, BITS_PER_KEY, BITMAP = 4, 16, 32768


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def places(key: Column, slots: Column) -> Column:
    """A key's places among ``slots`` bitmaps, as an array."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), slots * BITMAP) for i in range(1, PLACES + 1)])


def filters_of(keys: DataFrame) -> DataFrame:
    """Bloom filters of keys ``(dedup_key, bucket)``, cut into bitmaps of 4 KB."""
    sizes = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / BITMAP).cast("long").alias("slots"))
    placed = keys.join(sizes, "bucket").select("bucket", "slots", F.explode(places(F.col("dedup_key"), F.col("slots"))).alias("place"))
    return (
        placed.groupBy("bucket", "slots", F.floor(F.col("place") / BITMAP).cast("long").alias("slot"))
        .agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits"))
        .select("slots", "slot", "bits", "bucket")
    )


def bit_is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


class KeyTable:
    """Keys by entry, below ``root``; ``buckets`` is fixed for the table's life."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, fanout: int = 8):
        self.spark = spark
        self.buckets = buckets
        by_bucket = {name: ["bucket"] for name in SCHEMAS}
        self.log = SegmentLog(spark, root, SCHEMAS, self._merged, by_bucket, fanout)

    def _parts(self, keys: DataFrame) -> Parts:
        """An entry's parts, a bucket in as few files as its size allows."""
        dealt = materialize(keys.hint("rebalance", "bucket"))
        return {DATA: dealt, FILTER: filters_of(dealt)}

    def _merged(self, parts: Parts) -> Parts:
        return self._parts(parts[DATA].groupBy("dedup_key", "bucket").agg(F.min("entry").alias("entry")))

    def add(self, entry: int, keys: DataFrame) -> None:
        """Store an entry's ``dedup_key`` values."""
        distinct = keys.select("dedup_key").distinct().withColumn("bucket", bucket_of(F.col("dedup_key"), self.buckets))
        self.log.write(entry, self._parts(stamped(distinct, entry)))

    def may_be_known(self, keys: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
        """The ``keys`` (with ``bucket``) that the filter of some segment admits."""
        admitted = None
        for segment in segments:
            filters = self.log.read(FILTER, [segment])
            sizes = filters.select("bucket", "slots").distinct()
            asked = keys.join(sizes, "bucket").select(
                "dedup_key", "bucket", F.explode(places(F.col("dedup_key"), F.col("slots"))).alias("place")
            )
            slot = F.floor(F.col("place") / BITMAP).cast("long")
            hit = asked.withColumn("slot", slot).join(filters.drop("slots"), ["bucket", "slot"])
            found = (
                hit.where(bit_is_set(F.col("bits"), F.col("place") % BITMAP))
                .groupBy("dedup_key", "bucket")
                .agg(F.count(F.lit(1)).alias("_hits"))
                .where(F.col("_hits") == PLACES)
                .drop("_hits")
            )
            admitted = found if admitted is None else admitted.unionByName(found)
        return admitted.distinct()

    def known(self, keys: DataFrame, before: int) -> DataFrame:
        """Which of ``dedup_key`` an entry below ``before`` has stored."""
        segments = [s for s in self.log.segments() if s[0] < before]
        if not segments:
            return keys.select("dedup_key").limit(0)
        asked = keys.select("dedup_key").distinct().withColumn("bucket", bucket_of(F.col("dedup_key"), self.buckets))
        maybe = materialize(self.may_be_known(materialize(asked), segments))
        touched = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        stored = self.log.read(DATA, segments).where(F.col("bucket").isin(touched) & (F.col("entry") < before))
        return maybe.join(stored.select("bucket", "dedup_key"), ["bucket", "dedup_key"], "left_semi").select("dedup_key")
