"""The tables of one deployment below one root folder.

Every write of a run's rows replaces whole partitions (``run_id``, or ``run_id`` and
``commit_no``), so repeating a write after a lost executor or a crashed driver changes
nothing. Logs of single records (runs, commits, status marks) are sealed into few files. The
state as of a run lies in hash buckets; bringing it up to a later run rewrites the buckets
with events, and readers fold only the runs after it.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane import settings
from postlane.operators.health import failure_streaks
from postlane.operators.state import advance_state, import_legacy, latest_status, sighting_events
from postlane.schemas import STATE
from postlane.sources.buckets import BucketTable
from postlane.sources.keys import KeyTable, bucket_of
from postlane.sources.segments import SealedLog

POSTING_DDL = (
    "title string, company string, location string, url string, description string, "
    "posted_date string, source string, salary string"
)
SCHEMAS = {
    "run_events": "run_id long, kind string, at string, status string, raw_total long, "
    "new_count long, above_threshold long",
    "search_plans": "query_no long, query string, run_id long",
    "sightings": f"seq long, day string, {POSTING_DDL}, run_id long",
    "inputs": f"seq long, day string, {POSTING_DDL}, dedup_key string, idx long, batch long, "
    "pos int, run_id long, commit_no long",
    "answers": "batch long, raw string, error string, run_id long, commit_no long, attempt_no long",
    "commits": "run_id long, commit_no long, open_batches long",
    "scores": "dedup_key string, phase int, batch long, seq long, url string, title string, "
    "company string, source string, location string, salary string, score double, "
    "verdict string, data string, day string, run_id long, commit_no long",
    "attempts": "host string, failed boolean, day string, n long, run_id long",
    "status_marks": "url string, status string, at string, mark_no long",
}
# Logs that are appended to record by record.
LOGS = ("run_events", "commits", "status_marks")


class Store:
    """The tables of one deployment."""

    def __init__(self, spark: SparkSession, root: str, state_buckets: int = 256):
        self.spark = spark
        self.root = root
        self.kept_state = BucketTable(spark, os.path.join(root, "state"), STATE, "dedup_key", state_buckets)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str) -> DataFrame:
        """A table, empty if nothing was written yet."""
        if name in LOGS:
            return self.log(name).read()
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def log(self, name: str) -> SealedLog:
        return SealedLog(self.spark, self.path(name), SCHEMAS[name])

    def replace(self, name: str, df: DataFrame, partitions: list[str]) -> None:
        """Write ``df``, replacing exactly the partitions it has rows for."""
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(self.path(name))
        )

    def replace_run(self, name: str, df: DataFrame, run_id: int, partitions: list[str]) -> None:
        """Write a run's rows of a table in place of all that it had there."""
        (
            df.drop("run_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*partitions)
            .parquet(os.path.join(self.path(name), f"run_id={run_id}"))
        )

    def append(self, name: str, rows: list[tuple]) -> None:
        """Append a few log records."""
        self.log(name).append(rows)

    # -- one run -------------------------------------------------------------

    def write_sightings(self, run_id: int, day: str, postings: DataFrame) -> DataFrame:
        """Record a run's postings ``(seq, posting columns)`` and return them as stored."""
        stamped = postings.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("day", F.lit(day))
        columns = self.spark.createDataFrame([], SCHEMAS["sightings"]).columns
        self.replace("sightings", stamped.select(*columns), ["run_id"])
        return self.sightings(run_id)

    def sightings(self, run_id: int) -> DataFrame:
        return self.read("sightings").where(F.col("run_id") == run_id)

    def write_snapshot_files(self, run_id: int, kind: str, df: DataFrame) -> None:
        """Keep one dataset of a run as JSON lines, for reading by other tools."""
        target = os.path.join(self.path("runs"), f"run_id={run_id}", kind)
        df.write.mode("overwrite").json(target)

    def scored_keys(self, before: int) -> KeyTable:
        """The keys of scored micro-batches, taken from the scores where there is no table yet."""
        keys = KeyTable(self.spark, self.path("scored_keys"))
        if before > 0 and not keys.log.segments():
            earlier = self.read("scores").where(F.col("run_id") < before)
            keys.add(before - 1, earlier)
        return keys

    # -- host health and status marks ------------------------------------------

    def write_attempts(self, run_id: int, attempts: DataFrame) -> None:
        """Store a run's counted attempts ``(host, failed, day, n)``, ``n`` being their order."""
        stamped = attempts.withColumn("run_id", F.lit(run_id).cast("long"))
        self.replace("attempts", stamped.select("host", "failed", "day", "n", "run_id"), ["run_id"])

    def host_health(self) -> DataFrame:
        """Consecutive failures per host over all runs."""
        # A run may try a host very often: its attempts are walked in bounded pieces.
        chunk = F.struct("run_id", F.floor(F.col("n") / settings.ID_CHUNK).alias("piece"))
        return failure_streaks(self.read("attempts"), chunk, ["run_id", "n"])

    def mark_status(self, url: str, status: str, at: str, mark_no: int = 0) -> None:
        """Append one status mark; ``none`` clears the status of the URL."""
        if status not in settings.MARK_STATUSES:
            raise ValueError(f"status must be one of {', '.join(settings.MARK_STATUSES)}")
        self.append("status_marks", [(url, status, at, mark_no)])

    def statuses(self) -> DataFrame:
        return latest_status(self.read("status_marks"), ["at", "mark_no"])

    # -- state ---------------------------------------------------------------

    def events(self, after_run: int = -1) -> DataFrame:
        """Sightings and scores of the runs after ``after_run`` (partitions are pruned)."""
        seen = sighting_events(self.read("sightings").where(F.col("run_id") > after_run))
        scored = self.read("scores").where(F.col("run_id") > after_run)
        return seen.unionByName(scored.select(*seen.columns))

    def newest_snapshot(self) -> int | None:
        """The last run that the stored state holds."""
        return self.kept_state.as_of()

    def state(self, keyed: DataFrame | None = None) -> DataFrame:
        """The stored state advanced by all later runs.

        With ``keyed``, only buckets that hold one of its ``dedup_key`` values are read, so
        that looking a few postings up costs a few buckets.
        """
        newest = self.newest_snapshot()
        buckets = None if keyed is None else self.kept_state.touched(keyed)
        events = self.events(-1 if newest is None else newest)
        if buckets is not None:
            events = events.where(bucket_of(F.col("dedup_key"), self.kept_state.buckets).isin(buckets))
        return advance_state(None if newest is None else self.kept_state.read(buckets), events)

    def import_legacy(self, seen: DataFrame, scored: DataFrame, today: str) -> bool:
        """Take over an earlier tool's exports as the first state, unless there is any.

        See ``operators.state.import_legacy`` for the columns. Returns whether it was done.
        """
        if self.newest_snapshot() is not None or not self.events().isEmpty():
            return False
        imported = import_legacy(self.state(), seen, scored, today)
        self.kept_state.replace(imported, self.kept_state.touched(imported), 0)
        return True

    def compact(self, run_id: int) -> list[int]:
        """Bring the stored state up to ``run_id``, the newest run; returns the rewritten buckets."""
        newest = self.newest_snapshot()
        events = self.events(-1 if newest is None else newest)
        return self.kept_state.change(events, run_id, advance_state)


def export_json(df: DataFrame, path: str) -> None:
    """Write an export as JSON lines; the order of a sorted frame is kept over its files."""
    df.write.mode("overwrite").json(path)


def export_objects(df: DataFrame, path: str) -> None:
    """Write one column of JSON texts as JSON lines, each line being the object itself."""
    df.write.mode("overwrite").text(path)
