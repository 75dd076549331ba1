"""Streams that lose no row: what comes late or twice goes to a side table.

Spark's own stateful operators drop rows behind the watermark, and forget keys behind it.
Here every micro-batch is one entry of a segment log whose parts are the result, the side
table and the watermark, so they count together or not at all. A replay sees the watermark
of the entries before its own and so divides its rows as the first attempt did. Rows in are
rows out plus rows in the side table, whatever the order in which files arrive.
"""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.operators.state import with_key
from postlane.session import materialize
from postlane.sources.keys import KeyTable
from postlane.sources.segments import Parts, SegmentLog

COUNTS, LATE, MARK = "counts", "late", "mark"
KEPT, SIDE = "kept", "side"


def _merged_days(parts: Parts) -> Parts:
    return {
        COUNTS: parts[COUNTS].groupBy("source", "day").agg(F.sum("n").alias("n")),
        LATE: parts[LATE],
        MARK: parts[MARK].agg(F.max("high").alias("high"), F.sum("n_rows").alias("n_rows")),
    }


class DayCounts:
    """Rows ``(source, ts, ...)`` counted per source and day of ``ts``, late ones set aside.

    A row is late if its day had ended ``delay`` before the newest time of the earlier
    micro-batches; rows without a time are late too. ``row_ddl`` is the rows' schema.
    """

    def __init__(self, spark: SparkSession, root: str, row_ddl: str, delay: timedelta, fanout: int = 8):
        self.delay = delay
        schemas = {COUNTS: "source string, day string, n long", LATE: row_ddl, MARK: "high timestamp, n_rows long"}
        self.log = SegmentLog(spark, root, schemas, _merged_days, fanout=fanout)

    def watermark(self, before: int | None = None):
        """The time behind which days are closed, as of the entries before one; None at first."""
        segments = [s for s in self.log.segments() if before is None or s[1] < before]
        high = self.log.read(MARK, segments).agg(F.max("high")).first()[0]
        return None if high is None else high - self.delay

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` function."""
        rows = materialize(batch)
        mark = self.watermark(batch_id)
        ended = F.date_trunc("day", "ts") + F.expr("interval 1 day")
        late = F.col("ts").isNull() | (F.lit(False) if mark is None else ended <= F.lit(mark))
        day = F.date_format("ts", "yyyy-MM-dd").alias("day")
        counts = rows.where(~late).groupBy("source", day).agg(F.count(F.lit(1)).alias("n"))
        high = rows.agg(F.max("ts").alias("high"), F.count(F.lit(1)).alias("n_rows"))
        self.log.write(batch_id, {COUNTS: counts, LATE: rows.where(late), MARK: high})

    def late(self) -> DataFrame:
        return self.log.read(LATE)

    def counts(self, with_late: bool = False) -> DataFrame:
        """Rows per source and day; with the late ones that have a time, if they are wanted."""
        found = self.log.read(COUNTS)
        if with_late:
            timed = self.late().where(F.col("ts").isNotNull())
            found = found.unionByName(timed.select("source", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).cast("long").alias("n")))
        return found.groupBy("source", "day").agg(F.sum("n").alias("n"))

    def closed_days(self) -> DataFrame:
        """Counts of days that no row on time can add to any more."""
        mark = self.watermark()
        ended = F.col("day").cast("timestamp") + F.expr("interval 1 day")
        return self.counts().where(F.lit(False) if mark is None else ended <= F.lit(mark))

    def rows_seen(self) -> int:
        return self.log.read(MARK).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


class KeptOnce:
    """Postings deduplicated by key over the whole life of a stream, repeats set aside.

    The first row of a key by ``order`` stays, within its micro-batch and against all
    earlier ones, whose keys are looked up by bucket. There is no horizon behind which a
    key is forgotten. ``row_ddl`` is the schema of the postings.
    """

    def __init__(self, spark: SparkSession, root: str, row_ddl: str, order: list[str], fanout: int = 8):
        self.order = order
        side = f"{row_ddl}, dedup_key string, reason string"
        schemas = {KEPT: f"{row_ddl}, dedup_key string", SIDE: side}
        self.log = SegmentLog(spark, os.path.join(root, "rows"), schemas, fanout=fanout)
        self.keys = KeyTable(spark, os.path.join(root, "keys"), fanout=fanout)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` function; keys follow the rows, so a replay mends a crash in between."""
        rows = materialize(with_key(batch).withColumn("_row", F.monotonically_increasing_id()))
        first = rows.groupBy("dedup_key").agg(F.min_by("_row", F.struct(*self.order, "_row")).alias("_row"))
        known = materialize(self.keys.known(rows, batch_id)).withColumn("_known", F.lit(True))
        marked = (
            rows.join(first.select("_row").withColumn("_first", F.lit(True)), "_row", "left")
            .join(known, "dedup_key", "left")
            .withColumn("reason", F.when(F.col("_known"), F.lit("stored")).when(F.col("_first").isNull(), F.lit("repeat")))
        )
        divided = materialize(marked)
        self.log.write(
            batch_id, {KEPT: divided.where(F.col("reason").isNull()), SIDE: divided.where(F.col("reason").isNotNull())}
        )
        self.keys.add(batch_id, divided.where(F.col("reason").isNull()))

    def kept(self) -> DataFrame:
        return self.log.read(KEPT)

    def side(self) -> DataFrame:
        return self.log.read(SIDE)
