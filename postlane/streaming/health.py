"""Failure streaks kept up to date from a stream of attempts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.operators.health import fold_summaries, merge_summaries, summarize_attempts
from postlane.sources.segments import DATA, Parts, SegmentLog, stamped

SUMMARY_SCHEMA = (
    "host string, chunk string, n long, n_ok long, lead_fail long, trail_fail long, "
    "lead_days array<string>, inner_hit_day string, last_fail_day string, entry long"
)


def _in_order(summaries: DataFrame) -> DataFrame:
    """Chunks in the order of their micro-batches; a merged one stands at its first."""
    return summaries.withColumn("chunk", F.struct("entry", "chunk")).drop("entry")


def _merged(parts: Parts) -> Parts:
    """Neighbouring micro-batches as one: a row per host."""
    one = merge_summaries(_in_order(parts[DATA]))
    return {DATA: one.withColumn("entry", F.col("chunk.entry")).withColumn("chunk", F.col("chunk.chunk"))}


def summary_log(spark: SparkSession, path: str, fanout: int = 8) -> SegmentLog:
    """Summaries of all micro-batches, of which as many rows stay as segments have hosts."""
    return SegmentLog(spark, path, {DATA: SUMMARY_SCHEMA}, _merged, fanout=fanout)


def summary_writer(path: str, chunk: Column, order: list[str], fanout: int = 8) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the chunk summaries of a micro-batch.

    Keyed state per host would put a busy host's whole micro-batch into one task;
    summaries are built per (host, chunk) and only they meet per host. Micro-batches merge
    geometrically, so that a stream's summaries grow with the logarithm of its age.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        summaries = summarize_attempts(batch, chunk, order).withColumn("chunk", F.col("chunk").cast("string"))
        summary_log(batch.sparkSession, path, fanout).write(batch_id, {DATA: stamped(summaries, batch_id)})

    return write


def current_streaks(spark: SparkSession, path: str) -> DataFrame:
    """Health per host over all micro-batches, in the order they arrived."""
    return fold_summaries(_in_order(summary_log(spark, path).read()))


def summary_path(root: str) -> str:
    return os.path.join(root, "attempt_summaries")
