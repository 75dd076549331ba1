"""Mixing sources to target weights by Poisson replication.

Every document is repeated a random number of times. The number is the Poisson
distribution of its source's mean repetition rate, inverted at a uniform number hashed
from the seed and the document's id: it is the same on every machine, in every run and
for every partitioning, and no task ever needs to see a source's other documents. The
copies are then put into one global random order.

A source's rate is ``epochs * total mass * its weight / its mass``, masses in characters,
so the expected mass of every source is its share of the mixture. Masses are partial
sums, hence a source with a third of all rows costs one row per map task.

Defined results: a null text has mass 0 and is replicated like any other row; a null or
unlisted source belongs to the rest; rows with equal ids, null included, are drawn alike;
a group without mass has a rate of one, so its rows are drawn like others and stay once on
average (about 37 percent go, 26 percent come twice or more); an empty table gives an empty one. Input columns
named ``copy_no`` or ``shuffle_key`` (in any case) are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import hash52, others, unit_hash


def lowest_count(rate: Column) -> Column:
    """A count below which the distribution has no mass that a double could show."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 30), F.lit(0)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from ``lowest_count`` on, as an array that reaches 1 to double precision.

    The first term is found through logarithms, so that no rate is too large for it.
    """
    lowest = lowest_count(rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    factors = F.when(lowest > 0, F.sequence(F.lit(1), lowest)).otherwise(F.array().cast("array<int>"))
    first = F.exp(F.aggregate(factors, -rate, lambda total, i: total + F.log(rate / i)))

    def add(state, k):
        term = state["term"] * rate / k
        total = F.element_at(state["cdf"], -1) + term
        return F.struct(F.concat(state["cdf"], F.array(total)).alias("cdf"), term.alias("term"))

    start = F.struct(F.array(first).alias("cdf"), first.alias("term"))
    return F.aggregate(F.sequence(lowest + 1, last), start, add, lambda state: state["cdf"])


def source_rates(
    docs: DataFrame, weights: Mapping[str, float], rest_weight: float, epochs: float
) -> DataFrame:
    """One row per configured source and one for the rest: ``_group``, mass, rate."""
    listed = list(weights)
    total_weight = sum(weights.values()) + rest_weight
    shares = F.element_at(
        F.array(*[F.lit(weights[s] / total_weight) for s in listed], F.lit(rest_weight / total_weight)),
        F.col("_group") + 1,
    )
    masses = docs.select(
        group_of(docs, weights).alias("_group"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("_mass"),
    ).groupBy("_group").agg(F.sum("_mass").alias("mass"))
    # At most one row per configured source and one for the rest, so one row can hold them.
    totals = masses.agg(F.sum("mass").alias("total"), F.collect_list(F.struct("_group", "mass")).alias("_groups"))
    rate = F.when(F.col("mass") > 0, F.lit(float(epochs)) * F.col("total") * shares / F.col("mass")).otherwise(1.0)
    return totals.select("total", F.inline("_groups")).select("_group", "mass", rate.alias("rate"))


def group_of(docs: DataFrame, weights: Mapping[str, float]) -> Column:
    """Place of the row's source in the configuration, or the place after the last."""
    place = F.lit(len(weights))
    for i, source in enumerate(weights):
        place = F.when(docs["source"] == source, i).otherwise(place)
    return place


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    rest_weight: float,
    epochs: float = 1.0,
    seed: int = 1,
    id_column: str = "doc_id",
) -> DataFrame:
    """Rows repeated to the target mixture, in one global random order.

    Adds ``copy_no`` (from 1) and ``shuffle_key``; the result is sorted by the key.
    """
    rates = source_rates(docs, weights, rest_weight, epochs)
    steps = rates.select(
        F.col("_group").alias("__mix_group"),
        lowest_count(F.col("rate")).alias("__mix_lowest"),
        poisson_cdf(F.col("rate")).alias("__mix_cdf"),
    )
    kept = others(docs, "copy_no", "shuffle_key")
    own = docs.select(*kept, group_of(docs, weights).alias("__mix_group"))
    # ``steps`` has at most one row per configured source and one for the rest.
    drawn = own.join(F.broadcast(steps), "__mix_group")
    draw = unit_hash(seed, id_column)
    reached = F.filter("__mix_cdf", lambda share: share <= F.col("__mix_draw"))
    copies = F.col("__mix_lowest") + F.size(reached)
    out = (
        drawn.withColumn("__mix_draw", draw)
        .withColumn("__mix_copies", copies)
        .where(F.col("__mix_copies") > 0)
        .select(*kept, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("copy_no"))
    )
    return out.withColumn("shuffle_key", hash52(seed + 1, id_column, "copy_no")).orderBy("shuffle_key")
