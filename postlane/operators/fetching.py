"""Which pages to fetch: per-host caps, the page budget, hosts to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import urls
from postlane.operators.ordering import dedupe_first, first_per_group, interleave
from postlane.session import materialize


def discovered_pages(hits: DataFrame) -> DataFrame:
    """Hits deduplicated over all queries, then dealt round-robin over the queries.

    The first hit of a key in (query, hit) order stays; a query's rounds are numbered
    after that. The merged order is ``(round_no, query_no)``.
    """
    keyed = hits.withColumn("dedup_key", urls.dedup_key(F.col("url")))
    unique = dedupe_first(keyed, "dedup_key", ["query_no", "hit_no"])
    return interleave(unique, ["query_no"], [F.col("hit_no")], ["dedup_key"])


def host_caps_table(spark, caps: dict[str, int]) -> DataFrame:
    rows = [(host, int(cap)) for host, cap in caps.items()]
    return spark.createDataFrame(rows, "host string, cap int")


def apply_host_caps(
    pages: DataFrame,
    caps: dict[str, int],
    order: list[Column],
    default_cap: int | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """The first pages of every host up to its cap; a cap of 0 drops the host.

    Hosts without a cap of their own have ``default_cap``, or none if that is None; pages
    are then identified by ``key``. Dropped hosts go before any ranking. The largest cap
    bounds the rows a host can send to its ranking task; its own cap cuts the rest.
    """
    table = host_caps_table(pages.sparkSession, caps)
    hosted = pages.withColumn("host", urls.source_host(F.col("url")))
    limited = (
        # The caps come from configuration, which the driver holds already.
        hosted.join(F.broadcast(table), "host", "left")
        .withColumn("cap", F.coalesce("cap", F.lit(default_cap).cast("int")))
        .where(F.col("cap").isNull() | (F.col("cap") > 0))
    )
    highest = None if default_cap is None else max([default_cap, *caps.values()])
    ranked = first_per_group(limited, ["host"], order, highest, "host_rank", key or ["dedup_key"])
    return ranked.where(F.col("cap").isNull() | (F.col("host_rank") <= F.col("cap")))


def fetch_plan(pages: DataFrame, health: DataFrame, order: list[Column], budget: int | None = None) -> DataFrame:
    """The pages within the budget (all if it is None), each with the way it is to be served.

    ``snippet`` pages are on hosts that cannot be scraped or that keep failing. The
    budget is taken before the health lookup. Health has one row per host, so the join
    of a host with very many pages can be split.
    """
    chosen = pages if budget is None else materialize(pages.orderBy(*order).limit(budget))
    relevant = health.select("host", "consecutive_failures")
    blocked = F.col("host").isin(settings.UNSCRAPABLE_HOSTS)
    demoted = F.col("consecutive_failures") >= settings.FAILURES_BEFORE_DEMOTION
    return (
        chosen.join(relevant, "host", "left")
        .withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
        .withColumn("action", F.when(blocked | demoted, F.lit("snippet")).otherwise(F.lit("scrape")))
    )
