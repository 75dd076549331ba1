"""Host health: outcomes of fetch attempts and runs of consecutive failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import fields


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with ``http_status``, ``wait_s`` and ``outcome``.

    ``attempts`` is ``(host, page, try_no, failed, message, code, retry_after)``. A page
    is tried at most twice, the second time only after a 429. Payment errors abort the
    run and say nothing about the host; a retried attempt is superseded by its retry.
    """
    retry = Window.partitionBy("host", "page").orderBy("try_no")
    status = fields.http_status(F.col("message"), F.col("code"))
    classified = attempts.withColumn("http_status", F.when(F.col("failed"), status))
    is_first = F.row_number().over(retry) == 1
    has_retry = F.lead("try_no").over(retry).isNotNull()
    limited = F.coalesce(F.col("http_status") == 429, F.lit(False))
    return (
        classified.withColumn("_retried", is_first & has_retry)
        .withColumn(
            "outcome",
            F.when(~F.col("failed"), F.lit("ok"))
            .when(F.col("http_status") == 402, F.lit("abort"))
            .when(limited & F.col("_retried"), F.lit("retry"))
            .otherwise(F.lit("fail")),
        )
        .withColumn(
            "wait_s",
            F.when(F.col("outcome") == "retry", fields.retry_after(F.col("retry_after"))),
        )
        .drop("_retried")
    )


def attempt_log(classified: DataFrame) -> DataFrame:
    """The outcomes that count for host health."""
    return classified.where(F.col("outcome").isin("ok", "fail"))


# -- streaks --------------------------------------------------------------------
#
# A host may own a third of all attempts, so its history is never walked in one task.
# Attempts are summarized per (host, chunk of time); the summaries, a few numbers
# each, are then joined up per host. A summary holds what its neighbours need: the
# failures it starts and ends with, and where a streak first reached the limit.

LIMIT = settings.FAILURES_BEFORE_DEMOTION
SUMMARY_COLUMNS = [
    "host",
    "chunk",
    "n",
    "n_ok",
    "lead_fail",
    "trail_fail",
    "lead_days",
    "inner_hit_day",
    "last_fail_day",
]


def summarize_attempts(attempts: DataFrame, chunk, order: list[str]) -> DataFrame:
    """Chunk summaries of ``(host, failed, day, order columns)``.

    ``chunk`` is a column that grows with the order and bounds a chunk's attempts,
    such as the hour. Only one shuffle, on ``(host, chunk)``, is needed.
    """
    walk = Window.partitionBy("host", "chunk").orderBy(*order)
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok_place = F.when(~F.col("failed"), F.col("place"))
    streak = F.col("place") - F.coalesce(F.col("last_ok"), F.lit(0))
    walked = (
        attempts.withColumn("chunk", chunk)
        .withColumn("place", F.row_number().over(walk))
        .withColumn("ok_place", ok_place)
        .withColumn("last_ok", F.max("ok_place").over(so_far))
        .withColumn("streak", streak)
    )
    in_lead = F.col("last_ok").isNull()
    return (
        walked.groupBy("host", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("ok_place").alias("n_ok"),
            F.count_if(in_lead).alias("lead_fail"),
            (F.max("place") - F.coalesce(F.max("ok_place"), F.lit(0))).cast("long").alias("trail_fail"),
            # Days of the first failures of the chunk, up to the limit.
            F.array(
                *[F.max(F.when(in_lead & (F.col("place") == i), F.col("day"))) for i in range(1, LIMIT + 1)]
            ).alias("lead_days"),
            F.min(
                F.when(F.col("failed") & (F.col("streak") == LIMIT), F.struct("place", "day"))
            )["day"].alias("inner_hit_day"),
            F.max(F.when(F.col("failed"), F.col("day"))).alias("last_fail_day"),
        )
        .select(*SUMMARY_COLUMNS)
    )


def _linked(summaries: DataFrame) -> DataFrame:
    """Summaries with what earlier chunks of their host carry into them.

    ``block`` counts the chunks with a success so far, ``ends_with`` are the failures that
    the chunk ends with, ``hit_day`` is the day on which a streak reached the limit in it.
    """
    walk = Window.partitionBy("host").orderBy("chunk")
    whole = F.col("n_ok") == 0
    # Failures carried into a chunk: the tail of the last chunk with a success, plus
    # all of the failure-only chunks since.
    linked = (
        summaries.withColumn("block", F.sum((~whole).cast("long")).over(walk))
        .withColumn("tail", F.when(whole, F.col("n")).otherwise(F.col("trail_fail")))
        .withColumn(
            "ends_with",
            F.sum("tail").over(
                Window.partitionBy("host", "block")
                .orderBy("chunk")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("carry", F.coalesce(F.lag("ends_with").over(walk), F.lit(0)))
    )
    short = F.lit(LIMIT) - F.col("carry")
    completes = (F.col("carry") > 0) & (F.col("carry") < LIMIT) & (F.col("lead_fail") >= short)
    hit_day = F.when(
        completes, F.try_element_at(F.col("lead_days"), F.greatest(short, F.lit(1)).cast("int"))
    ).otherwise(F.col("inner_hit_day"))
    return linked.withColumn("hit_day", hit_day).withColumn("place", F.row_number().over(walk))


def _first_hit() -> Column:
    return F.min(F.when(F.col("hit_day").isNotNull(), F.struct("chunk", "hit_day")))


def _last_failure() -> Column:
    return F.max_by("last_fail_day", F.when(F.col("last_fail_day").isNotNull(), F.col("chunk")))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Neighbouring chunks of a host as one summary, under the first chunk.

    Associative: folding merged summaries gives what folding their parts gives, as long as
    the chunks of a merge lie together in the host's order.
    """
    # The failures that a host's merged chunk starts with: those of its failure-only
    # chunks before any success, and those that the first chunk with a success starts with.
    lead = F.when(F.col("block") == 0, F.col("n")).when(
        (F.col("block") == 1) & (F.col("n_ok") > 0), F.col("lead_fail")
    )
    days = F.filter("lead_days", lambda d: d.isNotNull())
    # A leading chunk has a failure at least, but for the last: so many hold the first days.
    leading = lead.isNotNull() & (F.col("place") <= LIMIT)
    found = _linked(summaries).groupBy("host").agg(
        F.min("chunk").alias("chunk"),
        F.sum("n").alias("n"),
        F.sum("n_ok").alias("n_ok"),
        F.sum(F.coalesce(lead, F.lit(0))).alias("lead_fail"),
        F.max_by("ends_with", "chunk").alias("trail_fail"),
        F.array_sort(F.collect_list(F.when(leading, F.struct("chunk", days.alias("days"))))).alias("_lead"),
        _first_hit()["hit_day"].alias("inner_hit_day"),
        _last_failure().alias("last_fail_day"),
    )
    # As long as the limit, missing days are null.
    first_days = F.slice(F.flatten(F.transform("_lead", lambda x: x["days"])), 1, LIMIT)
    padded = F.transform(F.sequence(F.lit(1), F.lit(LIMIT)), lambda i: F.get(first_days, i - 1))
    return found.withColumn("lead_days", padded).select(*SUMMARY_COLUMNS)


def fold_summaries(summaries: DataFrame) -> DataFrame:
    """Health per host: ``consecutive_failures``, ``last_failure``, ``demoted``.

    A host is no longer tried once its streak reaches the limit, so it keeps that
    count and the day it was reached. Hosts whose last attempt succeeded are absent.
    """
    return (
        _linked(summaries)
        .groupBy("host")
        .agg(_first_hit().alias("hit"), F.max_by("ends_with", "chunk").alias("streak"), _last_failure().alias("last_day"))
        .select(
            "host",
            F.when(F.col("hit").isNotNull(), F.lit(LIMIT)).otherwise(F.col("streak")).cast("long").alias(
                "consecutive_failures"
            ),
            F.coalesce(F.col("hit.hit_day"), F.col("last_day")).alias("last_failure"),
            F.col("hit").isNotNull().alias("demoted"),
        )
        .where(F.col("consecutive_failures") > 0)
    )


def failure_streaks(attempts: DataFrame, chunk, order: list[str]) -> DataFrame:
    return fold_summaries(summarize_attempts(attempts, chunk, order))
