"""Search hits, fetched pages and extraction results as postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import text, urls
from postlane.functions.text import first_nonempty, or_blank
from postlane.schemas import POSTING_COLUMNS

HIT_SCHEMA = "struct<url string, title string, description string>"
EXTRACT_SCHEMA = (
    "struct<title string, company string, location string, url string, "
    "posted_date string, description string>"
)
ANCHOR_PATTERN = r'<a\s[^>]*?href="([^"]*)"[^>]*>([\s\S]*?)</a>'


def search_hits(landed: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Landed hit lists ``(query_no, payload)`` to hits in query and hit order.

    With ``max_hits`` only a query's first hits are read; hits without a URL are dropped
    after that.
    """
    hits = landed.select("query_no", F.posexplode(F.from_json("payload", "array<string>")))
    if max_hits is not None:
        hits = hits.where(F.col("pos") < max_hits)
    hit = F.from_json("col", HIT_SCHEMA)
    return hits.select("query_no", F.col("pos").alias("hit_no"), hit.alias("h")).select(
        "query_no",
        "hit_no",
        F.col("h.url").alias("url"),
        or_blank(F.col("h.title")).alias("title"),
        or_blank(F.col("h.description")).alias("description"),
    ).where(F.length("url") > 0)


def _clean_postings(found: DataFrame, keep: list[str]) -> DataFrame:
    """Trimmed postings with a title, their URL resolved against the page's."""
    return found.select(
        *keep,
        text.strip(or_blank(F.col("p.title"))).alias("title"),
        text.strip(or_blank(F.col("p.company"))).alias("company"),
        F.coalesce(
            first_nonempty(text.strip(or_blank(F.col("p.location")))),
            F.lit(settings.DEFAULT_LOCATION),
        ).alias("location"),
        urls.resolve_url(F.col("page_url"), text.strip(or_blank(F.col("p.url")))).alias("url"),
        text.strip(or_blank(F.col("p.description"))).alias("description"),
        text.strip(or_blank(F.col("p.posted_date"))).alias("posted_date"),
        urls.source_host(F.col("page_url")).alias("source"),
        F.lit(None).cast("string").alias("salary"),
    ).where(F.col("title") != "")


def anchor_postings(pages: DataFrame) -> DataFrame:
    """Every link of a raw page ``(page_id, url, html)`` as a posting.

    ``pos`` is the link's place in its page; links without text are dropped.
    """
    html = F.col("html")
    links = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR_PATTERN), 1).alias("href"),
        F.regexp_extract_all(html, F.lit(ANCHOR_PATTERN), 2).alias("label"),
    )
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(links)).select(
        "page_id",
        "page_url",
        "pos",
        F.struct(
            text.html_to_text(F.col("col.label")).alias("title"),
            F.lit("").alias("company"),
            F.lit("").alias("location"),
            text.html_unescape(F.col("col.href")).alias("url"),
            F.lit("").alias("posted_date"),
            F.lit("").alias("description"),
        ).alias("p"),
    )
    return _clean_postings(found, ["page_id", "page_url", "pos"])


def extracted_postings(pages: DataFrame) -> DataFrame:
    """Postings of extraction results, or the page's own snippet where there are none.

    Pages are ``(page_no, url, title, description, payload)``; ``page_no`` is unique.
    A payload that is not an object, holds no array, or holds no element with a title
    yields the snippet posting. Good elements are picked inside the row, so the
    fallback needs no join.
    """
    parsed = F.transform(
        F.from_json("payload", "struct<jobs: array<string>>")["jobs"],
        lambda x: F.from_json(x, EXTRACT_SCHEMA),
    )
    indexed = F.transform(parsed, lambda x, i: F.struct(i.alias("pos"), x.alias("p")))
    usable = F.filter(indexed, lambda x: text.strip(or_blank(x["p"]["title"])) != "")
    found = pages.select(
        "page_no",
        F.col("url").alias("page_url"),
        F.col("title").alias("page_title"),
        F.col("description").alias("page_description"),
        F.explode_outer(usable).alias("item"),
    )
    host = urls.source_host(F.col("page_url"))
    has_item = F.col("item").isNotNull()

    def value(c, snippet):
        return F.when(has_item, c).otherwise(snippet)

    p = F.col("item.p")
    blank = F.lit("")
    remote = F.lit(settings.DEFAULT_LOCATION)
    resolved = urls.resolve_url(F.col("page_url"), text.strip(or_blank(p["url"])))
    return found.select(
        "page_no",
        F.coalesce(F.col("item.pos"), F.lit(0)).alias("pos"),
        value(text.strip(or_blank(p["title"])), F.col("page_title")).alias("title"),
        value(text.strip(or_blank(p["company"])), blank).alias("company"),
        value(
            F.coalesce(first_nonempty(text.strip(or_blank(p["location"]))), remote), remote
        ).alias("location"),
        value(resolved, F.col("page_url")).alias("url"),
        value(text.strip(or_blank(p["description"])), F.col("page_description")).alias(
            "description"
        ),
        value(text.strip(or_blank(p["posted_date"])), blank).alias("posted_date"),
        host.alias("source"),
        F.lit(None).cast("string").alias("salary"),
    )


def posting_columns(df: DataFrame) -> DataFrame:
    return df.select(*POSTING_COLUMNS)
