"""Ordered operators that stay exact and balanced when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane import settings
from postlane.session import kept_once, materialize


def dedupe_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order`` (which must be unique within a key).

    ``min_by`` is combined on the map side, so a key with very many copies sends
    one row per map task to its reducer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str,
    spread: int = settings.SPREAD,
) -> DataFrame:
    """The first ``k`` rows of every group by ``order``, numbered from 1 in ``rank``.

    A group is first cut into up to ``spread`` subsets by input partition, and each
    subset keeps its own first ``k``; the groups are then ranked over these. The
    result is the same for any cut. Both filters are recognised by Spark, which also
    drops rows beyond ``k`` before each shuffle, so no task ever ranks a whole group.
    """
    subset = Window.partitionBy(*group, "_subset").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_subset", F.spark_partition_id() % spread)
        .withColumn("_rank", F.row_number().over(subset))
        .where(F.col("_rank") <= k)
        .drop("_rank", "_subset")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )


def interleave(
    df: DataFrame, list_cols: Sequence[str], order: Sequence[Column], key: Sequence[str]
) -> DataFrame:
    """Deal lists round-robin: adds ``round_no``, the place of a row in its list.

    The merged order is ``(round_no, *list_cols)``: first rows of all lists, then
    second rows, and so on. A list may be of any length: no task numbers a whole one.
    """
    return rank_per_group(df, list_cols, order, "round_no", key)


def global_position(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "idx",
    partitions: int | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Exact 0-based position of every row in a unique order.

    ``key`` names columns that identify a row, by default the order's own. Only keys and
    order columns are range-partitioned, sorted and written to the shared checkpoint
    folder, with their place inside their partition. Row counts per partition give each
    partition's offset. The checkpoint fixes the partition borders: sampling them again
    in a second evaluation could move rows between partitions. Positions then join the
    rows by key, unless the rows are nothing but keys. Rows with more columns are computed
    once and kept by column: sorting reads their keys, the join reads the rest.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = list(key or order)
    if set(df.columns) != set(key):
        df = kept_once(df, "ranked")
    # monotonically_increasing_id: partition in the upper bits, row number in the lower 33.
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select(*key, F.monotonically_increasing_id().alias("_row"))
    ).select(*key, F.shiftright("_row", 33).alias("_part"), local.alias("_place"))
    # One row per partition, so a window over all of them is small by construction.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    positions = placed.join(F.broadcast(offsets), "_part").select(
        *key, (F.col("_offset") + F.col("_place")).alias(name)
    )
    if set(df.columns) == set(key):
        return positions
    renamed = positions.select(*[F.col(k).alias(f"_key_{k}") for k in key], name)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_key_{k}"]) for k in key])
    return df.join(renamed, same).drop(*[f"_key_{k}" for k in key])


def rank_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str, key: Sequence[str]
) -> DataFrame:
    """Every row's rank in its group from 1, however large the group.

    All rows get positions in the order (group, order); a group's first position then
    turns them into ranks. ``key`` names columns that identify a row.
    """
    placed = global_position(df, [*[F.col(g) for g in group], *order], "_position", key=key)
    first = placed.groupBy(*group).agg(F.min("_position").alias("_first"))
    renamed = first.select(*[F.col(g).alias(f"_group_{g}") for g in group], "_first")
    same = reduce(lambda a, b: a & b, [placed[g].eqNullSafe(renamed[f"_group_{g}"]) for g in group])
    ranked = placed.join(renamed, same).withColumn(rank, (F.col("_position") - F.col("_first") + 1).cast("int"))
    return ranked.drop("_position", "_first", *[f"_group_{g}" for g in group])


def first_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int | None,
    rank: str,
    key: Sequence[str],
) -> DataFrame:
    """The first ``k`` rows of every group, numbered; all rows if ``k`` is None."""
    if k is None:
        return rank_per_group(df, group, order, rank, key)
    return top_per_group(df, group, order, k, rank)


def next_in_order(df: DataFrame, id_col: str, value_col: str, name: str) -> DataFrame:
    """``value_col`` of the next higher ``id_col`` (unique), NULL for the last.

    Ids may be sparse and of any orderable type. Rows are sorted over range partitions and
    look for their neighbour in their own; the last row of each asks for the first of the
    next partition that has any, of which there is one per partition.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(partitions, id_col)
        .sortWithinPartitions(id_col)
        .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int"))
    )
    firsts = placed.groupBy("_part").agg(F.min_by(value_col, id_col).alias("_first")).collect()
    ordered = sorted(firsts, key=lambda r: r["_part"])
    # One row per partition.
    following = spark.createDataFrame(
        [(r["_part"], after["_first"]) for r, after in zip(ordered, ordered[1:])],
        f"_part int, _after {df.schema[value_col].dataType.simpleString()}",
    )
    inside = Window.partitionBy("_part").orderBy(id_col)
    last = F.lead(id_col).over(inside).isNull()
    return (
        placed.withColumn("_next", F.lead(value_col).over(inside))
        .withColumn("_last", last)
        .join(F.broadcast(following), "_part", "left")
        .withColumn(name, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next")))
        .drop("_part", "_next", "_last", "_after")
    )
