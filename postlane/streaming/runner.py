"""Run a stream over what has landed so far and wait for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, then stop; failures are raised here."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append a stream's rows to a Parquet folder, in its densest usual form, and read it back."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("compression", "zstd")
    drain(writer.option("path", path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``write(df, batch_id)``, which must be repeatable."""
    drain(stream.writeStream.foreachBatch(write), checkpoint)
