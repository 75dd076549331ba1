"""A keyed table in hash buckets, of which a change rewrites only what it touches.

Rows of unique keys lie in ``data/version=<v>/bucket=<b>``. A change writes the touched
buckets under a new version, then announces them in a manifest: one row per bucket with the
version that holds it. Readers go by the newest complete manifest, so a writer that dies
between data and manifest changes nothing, and its next try writes the same version again.
The manifest has as many rows as there are buckets, whatever the table's size; it and the
numbers of touched buckets are all that reaches the driver. Versions that neither of the
last two manifests names are deleted, so readers of the one before can finish.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlane.sources.keys import bucket_of
from postlane.sources.segments import children, remove

MANIFEST = "bucket int, version long, as_of long"
# Stands for the whole table in a manifest: every manifest has this row.
ALL = -1


class BucketTable:
    """Rows of ``schema`` by ``key``; ``buckets`` is fixed for the table's life."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 256):
        self.spark = spark
        self.root = root
        self.schema = schema
        self.key = key
        self.buckets = buckets

    def _data(self, version: int) -> str:
        return os.path.join(self.root, "data", f"version={version}")

    def _manifest(self, version: int) -> str:
        return os.path.join(self.root, "manifests", f"version={version}")

    def _announced(self) -> list[int]:
        """Versions with a complete manifest, newest first."""
        found = [int(n.removeprefix("version=")) for n in children(self.spark, os.path.join(self.root, "manifests"))]
        return [v for v in sorted(found, reverse=True) if "_SUCCESS" in children(self.spark, self._manifest(v))]

    def _placed(self, version: int) -> tuple[int, dict[int, int]]:
        """What a manifest says: the events it covers, and each filled bucket's version."""
        rows = self.spark.read.schema(MANIFEST).parquet(self._manifest(version)).collect()
        as_of = next(r["as_of"] for r in rows if r["bucket"] == ALL)
        return as_of, {r["bucket"]: r["version"] for r in rows if r["bucket"] != ALL}

    def as_of(self) -> int | None:
        """How far the newest state goes, None if there is none."""
        announced = self._announced()
        return self._placed(announced[0])[0] if announced else None

    def touched(self, keyed: DataFrame) -> list[int]:
        """The buckets of a frame's keys."""
        here = keyed.select(bucket_of(F.col(self.key), self.buckets).alias("bucket")).distinct()
        return sorted(r["bucket"] for r in here.collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest rows, of the given buckets alone if any are given."""
        announced = self._announced()
        placed = self._placed(announced[0])[1] if announced else {}
        paths = [
            os.path.join(self._data(v), f"bucket={b}") for b, v in sorted(placed.items()) if buckets is None or b in buckets
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def change(self, events: DataFrame, as_of: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets that ``events`` touch to ``merge(their rows, events)``; returns them."""
        buckets = self.touched(events)
        self.replace(merge(self.read(buckets), events) if buckets else None, buckets, as_of)
        return buckets

    def replace(self, rows: DataFrame | None, buckets: list[int], as_of: int) -> None:
        """Make ``rows`` the whole content of the given buckets, and announce it."""
        announced = self._announced()
        placed = self._placed(announced[0])[1] if announced else {}
        version = announced[0] + 1 if announced else 0
        written: list[int] = []
        if buckets:
            # Adaptive execution gives a bucket as many files as its size needs.
            dealt = rows.select(*self.schema.names, bucket_of(F.col(self.key), self.buckets).alias("bucket"))
            writer = dealt.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
            writer.partitionBy("bucket").parquet(self._data(version))
            written = [int(n.removeprefix("bucket=")) for n in children(self.spark, self._data(version)) if "=" in n]
        kept = {b: v for b, v in placed.items() if b not in buckets} | {b: version for b in written}
        self._announce(version, kept, as_of)
        self._expire()

    def _announce(self, version: int, placed: dict[int, int], as_of: int) -> None:
        rows = [(ALL, version, as_of), *[(b, v, as_of) for b, v in sorted(placed.items())]]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._manifest(version))

    def _expire(self) -> None:
        announced = self._announced()
        named = {place for v in announced[:2] for place in self._placed(v)[1].items()}
        for folder in children(self.spark, os.path.join(self.root, "data")):
            version = int(folder.removeprefix("version="))
            held = [int(n.removeprefix("bucket=")) for n in children(self.spark, self._data(version)) if "=" in n]
            if not any((b, version) in named for b in held):
                remove(self.spark, self._data(version))
                continue
            for b in held:
                if (b, version) not in named:
                    remove(self.spark, os.path.join(self._data(version), f"bucket={b}"))
        for version in announced[2:]:
            remove(self.spark, self._manifest(version))
