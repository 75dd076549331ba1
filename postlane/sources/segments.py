"""Logs of numbered entries in few files: segments that merge geometrically.

Every entry is written once, as a segment of its own. As soon as ``fanout`` neighbouring
segments of one size are complete they are merged into one, so ``n`` entries leave at most
``(fanout - 1) * log(n)`` segments, and every record is rewritten ``log(n)`` times. The
folder is its own manifest: a segment's name says which entries it holds, and it counts
once the committer's marker stands in each of its parts. A merged segment hides what it
covers from the moment it is complete. So a writer that dies while merging changes nothing,
and an entry that is written again (a replayed micro-batch) replaces itself, or is hidden by
the segment that already has it. What is hidden is deleted one merge later, so that readers
who have just listed the folder can finish. One writer at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"seg-(\d{12})-(\d{12})")
DATA = "data"

Parts = dict[str, DataFrame]


def union_of_parts(parts: Parts) -> Parts:
    """The records of a log whose merged segments are just longer; one file each."""
    return {name: df.coalesce(1) for name, df in parts.items()}


def children(spark: SparkSession, path: str) -> dict[str, bool]:
    """Names in a folder and whether they are folders; empty if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    return {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(folder)}


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class SegmentLog:
    """A log below ``root``; ``schemas`` and ``partitions`` are per part of an entry.

    ``merge`` maps the union of some neighbouring segments, per part, to the merged one.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schemas: dict[str, str],
        merge: Callable[[Parts], Parts] = union_of_parts,
        partitions: dict[str, list[str]] | None = None,
        fanout: int = 8,
    ):
        self.spark = spark
        self.root = root
        self.schemas = schemas
        self.merge = merge
        self.partitions = partitions or {}
        self.fanout = fanout

    def path(self, segment: tuple[int, int], part: str = DATA) -> str:
        return os.path.join(self.root, f"seg-{segment[0]:012d}-{segment[1]:012d}", part)

    def _listed(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The segments that count, in order, and complete ones that they hide."""
        named = [(int(m[1]), int(m[2])) for n in children(self.spark, self.root) if (m := NAME.fullmatch(n))]
        whole = [s for s in named if all("_SUCCESS" in children(self.spark, self.path(s, p)) for p in self.schemas)]
        live: list[tuple[int, int]] = []
        for first, last in sorted(whole, key=lambda s: (s[0], -s[1])):
            if not live or last > live[-1][1]:
                live.append((first, last))
        return live, [s for s in whole if s not in live]

    def segments(self) -> list[tuple[int, int]]:
        return self._listed()[0]

    def next_entry(self) -> int:
        live = self.segments()
        return live[-1][1] + 1 if live else 0

    def read(self, part: str = DATA, segments: list[tuple[int, int]] | None = None) -> DataFrame:
        """A part's records in the given segments, by default all; empty if there are none."""
        paths = [self.path(s, part) for s in (self.segments() if segments is None else segments)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[part])
        reader = self.spark.read.schema(self.schemas[part])
        if part not in self.partitions:
            return reader.parquet(*paths)
        # Partitioned folders have to be read one by one; there are few.
        return reduce(DataFrame.unionByName, [reader.parquet(path) for path in paths])

    def _store(self, segment: tuple[int, int], parts: Parts) -> None:
        for name in self.schemas:
            frame = parts[name].select(*self.spark.createDataFrame([], self.schemas[name]).columns)
            # Only a static overwrite leaves the marker behind.
            writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "static")
            writer.partitionBy(*self.partitions.get(name, [])).parquet(self.path(segment, name))

    def write(self, entry: int, parts: Parts) -> None:
        """Store an entry, then merge what has become complete with it.

        A replayed entry that a longer segment already holds is left as it is.
        """
        if any(first <= entry <= last and first < last for first, last in self.segments()):
            return
        self._store((entry, entry), parts)
        size = self.fanout
        while (entry + 1) % size == 0:
            self._merge_range(entry + 1 - size, entry)
            size *= self.fanout

    def _merge_range(self, first: int, last: int) -> None:
        live, hidden = self._listed()
        inside = [s for s in live if first <= s[0] and s[1] <= last]
        if len(inside) > 1:
            self._store((first, last), self.merge({p: self.read(p, inside) for p in self.schemas}))
        for segment in hidden:
            remove(self.spark, os.path.dirname(self.path(segment)))

    def append(self, rows: list[tuple]) -> None:
        """A few records as the next entry of a log with one part."""
        self.write(self.next_entry(), {DATA: self.spark.createDataFrame(rows, self.schemas[DATA]).coalesce(1)})


class SealedLog:
    """A log that many writers may append to, a few records at a time.

    Appends are loose files, safe side by side. As soon as there are ``seal_at`` of them
    they go into the next segment, every record with the name of its loose file. A loose
    file is deleted at a later sealing, once a segment that counts has its records. Until
    then its records are read twice, as they are after a crash: logs are folded by functions
    to which a repeated record makes no difference.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, seal_at: int = 64):
        self.spark = spark
        self.schema = schema
        self.seal_at = seal_at
        self.loose = os.path.join(root, "loose")
        self.sealed = SegmentLog(spark, os.path.join(root, "sealed"), {DATA: f"{schema}, loose string"})

    def _loose_files(self) -> list[str]:
        return sorted(n for n in children(self.spark, self.loose) if n.endswith(".parquet"))

    def _paths(self, names: list[str]) -> list[str]:
        return [os.path.join(self.loose, n) for n in names]

    def read(self) -> DataFrame:
        sealed = self.sealed.read().drop("loose")
        names = self._loose_files()
        if not names:
            return sealed
        return sealed.unionByName(self.spark.read.schema(self.schema).parquet(*self._paths(names)))

    def append(self, rows: list[tuple]) -> None:
        frame = self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.mode("append").parquet(self.loose)
        if len(self._loose_files()) >= self.seal_at:
            self.seal()

    def seal(self) -> None:
        names = self._loose_files()
        before = self.sealed.read().where(F.col("loose").isin(names)).select("loose").distinct()
        old = {r["loose"] for r in before.collect()}
        for name in old:
            remove(self.spark, os.path.join(self.loose, name))
        new = [n for n in names if n not in old]
        if new:
            records = self.spark.read.schema(self.schema).parquet(*self._paths(new))
            named = records.select("*", F.col("_metadata.file_name").alias("loose"))
            self.sealed.write(self.sealed.next_entry(), {DATA: named.coalesce(1)})


def stamped(df: DataFrame, entry: int) -> DataFrame:
    """Records stamped with their entry's number."""
    return df.withColumn("entry", F.lit(entry).cast("long"))
