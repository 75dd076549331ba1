"""Cross-run dedupe on a stream, within a bounded horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane import settings


def dedupe_stream(
    postings: DataFrame, ts: str, row_id: str, horizon: str, key: str = "dedup_key",
    spread: int = settings.SPREAD,
) -> DataFrame:
    """One row per key among rows whose times are within ``horizon`` of each other.

    A key with very many copies is first deduplicated in ``spread`` independent parts,
    chosen by ``row_id``; the second step then sees at most one copy per part.
    """
    part = F.pmod(F.xxhash64(row_id), F.lit(spread))
    return (
        postings.withWatermark(ts, horizon)
        .withColumn("_part", part)
        .dropDuplicatesWithinWatermark([key, "_part"])
        .dropDuplicatesWithinWatermark([key])
        .drop("_part")
    )
