"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.session import scratch_path

# White space of word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Quoted names of all columns but those that an operator's own columns replace."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in replaced]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, a null read as an empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the six white-space characters."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts lineage: what was computed survives lost executors, and nothing is derived
    twice. Used for narrow intermediate results that several later steps read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits, fixed by the seed and the columns' values."""
    return hash52(seed, *columns) / F.lit(float(1 << 52))


def hash52(seed: int, *columns: Column | str) -> Column:
    """The first 52 bits of an MD5 digest as a bigint; nulls count as the word null."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column as the output of a generator, which the optimizer never inlines.

    For arrays that a later lambda reads: inlined there, they would be derived again
    for every element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` elements of an array column of hashes."""
    places = F.sequence(F.lit(1), F.size(hashes) - width + 1)
    return F.when(F.size(hashes) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, width)))
    )


def bounded(sizes: list[int], together: int) -> Iterator[range]:
    """Ranges of rows whose sizes make about ``together``."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= together:
            yield range(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield range(start, len(sizes))
