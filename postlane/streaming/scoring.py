"""Score postings as they arrive; every micro-batch is one repeatable commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.operators import state
from postlane.operators.ordering import dedupe_first
from postlane.session import materialize
from postlane.sources.tables import Store


def commit_writer(
    store: Store, score: Callable[[DataFrame], DataFrame], order: list[str]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each micro-batch's scores.

    ``score`` maps ``(dedup_key, posting columns)`` to score events. Keys of earlier
    commits are skipped; they are looked up in the store's key table, which reads the
    buckets that the micro-batch may touch. Only earlier commits count: a replay of batch
    ``n`` after a crash reads the same input as its first attempt and overwrites its
    partition. Keys follow their scores, so a crash in between is mended by the replay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        unique = materialize(dedupe_first(state.with_key(batch), "dedup_key", order))
        known = store.scored_keys(batch_id).known(unique, batch_id)
        fresh = unique.join(known, "dedup_key", "left_anti")
        events = score(fresh).withColumn("run_id", F.lit(batch_id).cast("long")).withColumn(
            "commit_no", F.lit(0).cast("long")
        )
        store.replace_run("scores", events.select(*store.read("scores").columns), batch_id, ["commit_no"])
        store.scored_keys(batch_id).add(batch_id, store.read("scores").where(F.col("run_id") == batch_id))

    return write
