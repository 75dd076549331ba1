"""Job-board feeds: one normalizer per source, a registry, and the capped merge.

A landed feed is a table of raw payload texts ``(source, board, fetch_no, payload)``.
Arrays are parsed as arrays of text first and element by element after that, so that
one bad element never empties a payload, and one bad payload never empties a source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlane import settings
from postlane.functions import fields, pay, text
from postlane.functions.text import first_nonempty, or_blank
from postlane.operators.ordering import first_per_group, rank_per_group
from postlane.schemas import LANDED_FEED, POSTING_COLUMNS
from postlane.session import kept_once

ORDER_COLUMNS = ["board", "fetch_no", "pos"]


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads stored as JSON lines or Parquet below ``path``."""
    reader = spark.read.schema(LANDED_FEED)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload files below ``path/source=<name>/board=<name>``, one fetch per file.

    Fetches are ordered by the time their file was written.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("value", "source", "board")])
    files = spark.read.schema(schema).option("wholetext", True).format("text").load(path)
    hive_null = "__HIVE_DEFAULT_PARTITION__"
    return files.select(
        "source",
        F.when(F.col("board") != hive_null, F.col("board")).otherwise("").alias("board"),
        F.unix_micros("_metadata.file_modification_time").alias("fetch_no"),
        F.col("value").alias("payload"),
    )


def _with_default(c: Column) -> Column:
    return F.coalesce(first_nonempty(c), F.lit(settings.DEFAULT_LOCATION))


def _remotive(p: Column) -> dict[str, Column]:
    return {
        "title": p["title"],
        "company": p["company_name"],
        "location": _with_default(p["candidate_required_location"]),
        "url": p["url"],
        "description": p["description"],
        "posted_date": p["publication_date"],
        "salary": text.strip(or_blank(p["salary"])),
    }


def _remoteok(p: Column) -> dict[str, Column]:
    return {
        "title": p["position"],
        "company": p["company"],
        "location": _with_default(p["location"]),
        "url": p["url"],
        "description": text.strip_html(p["description"]),
        "posted_date": p["date"],
        "salary": pay.salary_range_text(p["salary_min"], p["salary_max"]),
    }


def _arbeitnow(p: Column) -> dict[str, Column]:
    return {
        "title": p["title"],
        "company": p["company_name"],
        "location": _with_default(p["location"]),
        "url": p["url"],
        "description": p["description"],
        "posted_date": p["created_at"],
        "salary": F.lit(None).cast("string"),
    }


def _sjs(p: Column) -> dict[str, Column]:
    uuid, body = text.strip(or_blank(p["uuid"])), text.strip_html(p["description"])
    after_summary = text.bind(
        body,
        lambda b: F.when(b != "", F.concat(F.lit(settings.SJS_SUMMARY_SEPARATOR), b)).otherwise(""),
    )
    own_page = F.concat(F.lit(settings.SJS_POSTING_URL), uuid)
    return {
        "title": text.strip(or_blank(p["title"])),
        "company": text.strip(or_blank(p["businessName"])),
        "location": fields.place_text(p["areaName"], p["regionName"]),
        "url": F.coalesce(first_nonempty(p["externalApplyUrl"], p["applyUrl"]), own_page),
        "description": F.concat(text.strip(or_blank(p["summary"])), after_summary),
        "posted_date": p["advertStartDateNz"],
        "salary": pay.pay_text(p["payMin"], p["payMax"], p["payType"]),
    }


def _greenhouse(p: Column) -> dict[str, Column]:
    return {
        "title": p["title"],
        "company": first_nonempty(p["company_name"], F.col("board")),
        "location": p["location"]["name"],
        "url": p["absolute_url"],
        "description": text.html_to_text(p["content"]),
        "posted_date": first_nonempty(p["first_published"], p["updated_at"]),
        "salary": F.lit(""),
    }


def _lever(p: Column) -> dict[str, Column]:
    plain = first_nonempty(p["descriptionPlain"], p["descriptionBodyPlain"])
    # The markup is only cleaned where no plain text exists.
    markup = F.when(plain.isNull(), p["descriptionBody"])
    return {
        "title": p["text"],
        "company": F.col("board"),
        "location": p["categories"]["location"],
        "url": first_nonempty(p["hostedUrl"], p["applyUrl"]),
        "description": F.coalesce(plain, text.html_to_text(markup)),
        "posted_date": fields.epoch_ms_to_date(p["createdAt"]),
        "salary": F.lit(""),
    }


def _adzuna(p: Column) -> dict[str, Column]:
    salary = pay.salary_range_text(p["salary_min"], p["salary_max"])
    return {
        "title": p["title"],
        "company": p["company"]["display_name"],
        "location": p["location"]["display_name"],
        "url": p["redirect_url"],
        "description": p["description"],
        "posted_date": p["created"],
        "salary": text.bind(salary, lambda s: pay.with_estimate(s, p["salary_is_predicted"])),
    }


@dataclass(frozen=True)
class Feed:
    """How one source's payloads become postings.

    ``array_field`` holds the postings ('' if the payload is the array), ``element`` is
    the read schema of one of them, ``columns`` gives the posting columns from the
    element read, ``board``, ``fetch_no`` and ``pos``, and ``where`` drops elements that are none.
    """

    array_field: str
    element: str
    columns: Callable[[Column], dict[str, Column]]
    where: Callable[[Column], Column] | None = None
    many_boards: bool = False
    newest_first: bool = False


def _has_uuid_and_title(p: Column) -> Column:
    return (text.strip(or_blank(p["uuid"])) != "") & (text.strip(or_blank(p["title"])) != "")


# The registry: a new source is one more entry. Names and fields are fixed by the feeds.
FEEDS = {
    "remotive.com": Feed(
        "jobs",
        "title string, company_name string, candidate_required_location string, url string, "
        "description string, publication_date string, salary string",
        _remotive,
    ),
    "remoteok.com": Feed(
        "",
        "position string, company string, location string, url string, date string, "
        "description string, salary_min string, salary_max string",
        _remoteok,
        # The first element of every payload is a legal notice.
        where=lambda p: F.col("pos") > 0,
    ),
    "arbeitnow.com": Feed(
        "data",
        "title string, company_name string, location string, url string, description string, "
        "created_at string",
        _arbeitnow,
    ),
    "sjs.co.nz": Feed(
        "",
        "uuid string, title string, businessName string, areaName string, regionName string, "
        "payMin string, payMax string, payType string, summary string, description string, "
        "advertStartDateNz string, externalApplyUrl string, applyUrl string",
        _sjs,
        where=_has_uuid_and_title,
        newest_first=True,
    ),
    "greenhouse": Feed(
        "jobs",
        "title string, company_name string, absolute_url string, location struct<name string>, "
        "content string, first_published string, updated_at string",
        _greenhouse,
        many_boards=True,
    ),
    "lever": Feed(
        "",
        "text string, hostedUrl string, applyUrl string, createdAt string, "
        "categories struct<location string>, descriptionPlain string, "
        "descriptionBodyPlain string, descriptionBody string",
        _lever,
        many_boards=True,
    ),
    "adzuna": Feed(
        "results",
        "title string, company struct<display_name string>, location struct<display_name string>, "
        "redirect_url string, description string, created string, salary_min string, "
        "salary_max string, salary_is_predicted string",
        _adzuna,
    ),
}


def elements(source: str, payload: Column) -> Column:
    """The payload's postings as an array of JSON texts; NULL for a dead payload."""
    field = FEEDS[source].array_field
    if not field:
        return F.from_json(payload, "array<string>")
    return F.from_json(payload, f"struct<{field}: array<string>>")[field]


def read_elements(df: DataFrame, sources: list[str]) -> DataFrame:
    """Adds per source the element read by its schema, NULL in rows of other sources.

    As the output of a generator: a filter on the fields stays above it, and an element is
    read once, not once for every field that the filter looks at.
    """
    each = [
        F.when(F.col("source") == s, F.from_json("col", f"struct<{FEEDS[s].element}>")).alias(f"_read_{i}")
        for i, s in enumerate(sources)
    ]
    return df.select("*", F.explode(F.array(F.struct(*each))).alias("_read")).select(*df.columns, "_read.*")


def by_source(sources: list[str], value: Callable[[str, Column], Column]) -> Column:
    """A value that each source derives in its own way from its element."""
    chosen = F.lit(None)
    for i, source in reversed(list(enumerate(sources))):
        chosen = F.when(F.col("source") == source, value(source, F.col(f"_read_{i}"))).otherwise(chosen)
    return chosen


def read_usable(landed: DataFrame, sources: list[str]) -> DataFrame:
    """The sources' elements that are postings, as text (``col``) and read, with their date."""
    payload = F.lit(None)
    for source in sources:
        payload = F.when(F.col("source") == source, elements(source, F.col("payload"))).otherwise(payload)
    listed = landed.where(F.col("source").isin(sources)).select(
        "source", "board", "fetch_no", F.posexplode(payload)
    )

    def usable(source: str, p: Column) -> Column:
        feed = FEEDS[source]
        right = F.length(or_blank(feed.columns(p)["url"])) > 0
        return right & feed.where(p) if feed.where else right

    dated = read_elements(listed, sources).where(by_source(sources, usable))
    date = by_source(sources, lambda s, p: or_blank(FEEDS[s].columns(p)["posted_date"]))
    return dated.withColumn("posted_date", date)


def usable_elements(landed: DataFrame, sources: list[str]) -> DataFrame:
    """The sources' elements that are postings, as text (``col``), with their date.

    ``posted_date`` is there for ranking: cleaning whole descriptions can then wait until
    caps have dropped most rows.
    """
    return read_usable(landed, sources).select("source", *ORDER_COLUMNS, "col", "posted_date")


def cleaned(rows: DataFrame, sources: list[str], *keep: str) -> DataFrame:
    """Posting columns of usable elements, after the columns to keep."""
    return posting_columns(read_elements(rows, sources), sources, *keep)


def posting_columns(read: DataFrame, sources: list[str], *keep: str) -> DataFrame:
    """Posting columns of elements that have been read, after the columns to keep.

    NULL becomes blank, except for the salary of a source that has none at all.
    """
    def column(name: str) -> Column:
        if name in ("source", "posted_date"):
            return F.col(name)
        blank = (lambda c: c) if name == "salary" else or_blank
        return by_source(sources, lambda s, p: blank(FEEDS[s].columns(p)[name])).cast("string")

    return read.select(*keep, *[column(name).alias(name) for name in POSTING_COLUMNS])


def normalize(landed: DataFrame, source: str) -> DataFrame:
    """All postings of one source, with their place in the feed."""
    return normalize_all(landed, [source])


def normalize_all(landed: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """All postings of several sources (of all feeds by default), the payloads read once."""
    known = [s for s in (sources if sources is not None else FEEDS) if s in FEEDS]
    return posting_columns(read_usable(landed, known), known, *ORDER_COLUMNS)


NORMALIZERS = {name: partial(normalize, source=name) for name in FEEDS}


def quarantine(landed: DataFrame) -> DataFrame:
    """Each payload with ``n_elements``; NULL marks a dead payload to look at."""
    count = F.lit(None).cast("int")
    for source in FEEDS:
        count = F.when(
            F.col("source") == source, F.array_size(elements(source, F.col("payload")))
        ).otherwise(count)
    return landed.select("source", "board", "fetch_no", count.alias("n_elements"))


def payload_array(source: str, value: Column) -> Column:
    """The postings of a parsed payload (a VARIANT) as an array of variants; NULL if there is no array."""
    return F.try_variant_get(value, array_path(source), "array<variant>")


def array_path(source: str) -> str:
    """Where a source's payload has its postings."""
    field = FEEDS[source].array_field
    return f"$.{field}" if field else "$"


def judged_payloads(landed: DataFrame) -> DataFrame:
    """Every payload with a ``reason`` if it lacks what its source promises, and the first bad ``path``.

    See ``faults``; the reason of a sound payload is NULL.
    """
    known = list(FEEDS)

    def of_source(choose: Callable[[str], Column]) -> Column:
        chosen = F.lit(None)
        for source in known:
            chosen = F.when(F.col("source") == source, choose(source)).otherwise(chosen)
        return chosen

    parsed = (
        landed.where(F.col("source").isin(known))
        .withColumn("_value", F.try_parse_json("payload"))
        .withColumn("_array", of_source(lambda s: payload_array(s, F.col("_value"))))
        .withColumn("_path", of_source(lambda s: F.lit(array_path(s))))
        # A payload that the parser takes as a whole may still be one that the feed reader rejects.
        .withColumn("_read", of_source(lambda s: F.array_size(elements(s, F.col("payload")))))
    )
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    odd = F.array_position(F.transform("_array", lambda v: ~is_object(v)), F.lit(True))
    found = parsed.withColumn("_odd", odd - 1).withColumn(
        "reason",
        F.when(text.strip(or_blank(F.col("payload"))) == "", F.lit("empty"))
        .when(F.col("_value").isNull(), F.lit("not JSON"))
        .when(F.col("_array").isNull() | F.col("_read").isNull(), F.lit("no array"))
        .when(F.col("_odd") >= 0, F.lit("odd element")),
    )
    path = F.when(F.col("reason") == "no array", F.col("_path")).when(
        F.col("reason") == "odd element", F.concat("_path", F.lit("["), F.col("_odd").cast("string"), F.lit("]"))
    )
    return found.select("source", "board", "fetch_no", "reason", path.alias("path"))


def faults(landed: DataFrame) -> DataFrame:
    """Payloads that lack what a source promises, with a ``reason`` and the first bad ``path``.

    ``empty`` and ``not JSON`` payloads are dead as a whole, ``no array`` ones have something
    else where the postings should be; in all of these no posting is read. ``odd element``
    payloads are read without the element at ``path``, the first that is no object.
    """
    return judged_payloads(landed).where(F.col("reason").isNotNull())


def fault_summary(landed: DataFrame) -> DataFrame:
    """Payloads per source, reason (``sound`` if there is none) and path, and the first such fetch."""
    reason = F.coalesce("reason", F.lit("sound")).alias("reason")
    return judged_payloads(landed).groupBy("source", reason, F.coalesce("path", F.lit("")).alias("path")).agg(
        F.count(F.lit(1)).alias("n_payloads"), F.min("fetch_no").alias("first_fetch_no")
    )


def drift_summary(landed: DataFrame) -> DataFrame:
    """Per source the schema of all its postings together, and the fields that the reader misses.

    Schemas are merged on the map side. A field that a source has given up shows up in
    ``missing_fields``; the reader would take it as blank.
    """
    parts = []
    for source, feed in FEEDS.items():
        parsed = landed.where(F.col("source") == source).select(F.try_parse_json("payload").alias("_value"))
        postings = parsed.select(F.explode(payload_array(source, F.col("_value"))).alias("_posting"))
        merged = postings.agg(F.schema_of_variant_agg("_posting").alias("schema"), F.count(F.lit(1)).alias("n_postings"))
        wanted = [f.name for f in T.StructType.fromDDL(feed.element).fields]
        present = F.regexp_extract_all(F.col("schema"), F.lit(r"[<,] ?([A-Za-z_][A-Za-z0-9_]*): "), 1)
        missing = F.array_except(F.array(*map(F.lit, wanted)), present)
        parts.append(
            merged.where(F.col("n_postings") > 0).select(
                F.lit(source).alias("source"), "n_postings", "schema", F.array_join(missing, ",").alias("missing_fields")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def board_rounds(
    rows: DataFrame, boards: list[str] | None = None, cap: int | None = None
) -> DataFrame:
    """The newest rows of each board, dealt round-robin.

    Adds ``round_no`` (1 = the newest of its board) and ``list_no`` (the board's place
    in the configuration, by name if there is none); the merged order is the two
    together. With a source cap a board counts up to it only.
    """
    place = F.col("board")
    if boards is not None:
        rows = rows.where(F.col("board").isin(boards))
        place = board_place(boards)
    newest = [F.col("posted_date").desc(), F.col("fetch_no"), F.col("pos")]
    ranked = first_per_group(rows, ["source", "board"], newest, cap, "round_no", ["source", *ORDER_COLUMNS])
    return ranked.withColumn("list_no", place)


def board_place(boards: list[str]) -> Column:
    """A board's place in a list, as text of equal length."""
    names = F.array(*[F.lit(b) for b in boards]).cast("array<string>")
    return F.lpad(F.array_position(names, F.col("board")).cast("string"), 10, "0")


def unknown_sources(sources: list[str]) -> list[str]:
    """Configured names that no feed is registered for."""
    return [name for name in sources if name not in FEEDS]


def merge_feeds(
    landed: DataFrame,
    sources: list[str],
    ats_boards: dict[str, list[str]] | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Postings of every configured source in merged order, up to ``cap`` of each.

    ``list_no`` and ``slot`` give the order: sources as configured, then slots. Names
    without a feed are skipped (see ``unknown_sources``). All sources go through one
    plan: the landed texts are read once, one ranking orders boards, one sources, and elements are
    only cleaned after both.
    """
    known = [name for name in sources if name in FEEDS]
    if not known:
        columns = ", ".join(f"{name} string" for name in POSTING_COLUMNS)
        return landed.sparkSession.createDataFrame([], f"{columns}, slot int, list_no int")
    is_one_of = lambda names: F.col("source").isin(names) if names else F.lit(False)
    many = is_one_of([name for name in known if FEEDS[name].many_boards])
    newest = is_one_of([name for name in known if FEEDS[name].newest_first])
    rows = usable_elements(landed, known)
    place = F.col("board")
    if ats_boards is not None:
        listed = {name: list(ats_boards.get(name, [])) for name in known if FEEDS[name].many_boards}
        wanted = [is_one_of([name]) & F.col("board").isin(boards) for name, boards in listed.items()]
        rows = rows.where(~many | reduce(lambda a, b: a | b, wanted, F.lit(False)))
        for name, boards in listed.items():
            place = F.when(F.col("source") == name, board_place(boards)).otherwise(place)
    key = ["source", *ORDER_COLUMNS]
    # Inside a board the order is the source's own, so a board's first rows suffice.
    in_board = [F.when(many | newest, F.col("posted_date")).desc(), F.col("fetch_no"), F.col("pos")]
    in_source = [
        F.when(many, F.col("round_no")).otherwise(0),
        F.when(newest, F.col("posted_date")).desc(),
        place,
        F.col("fetch_no"),
        F.col("pos"),
    ]
    if cap is None:
        # Whole groups are ranked: elements are kept once, ranks are made of their keys and
        # dates alone, and the texts are joined once, at the end.
        rows = kept_once(rows, "elements")
        keys = rows.drop("col")
        several = rank_per_group(keys.where(many), ["source", "board"], in_board, "round_no", keys.columns)
        single = keys.where(~many).withColumn("round_no", F.lit(0))
        ranked = several.unionByName(single)
        slots = rank_per_group(ranked, ["source"], in_source, "slot", ranked.columns).select(*key, "slot")
        named = slots.select(*[F.col(c).alias(f"_key_{c}") for c in key], "slot")
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"_key_{c}"]) for c in key])
        first = rows.join(named, same).drop(*[f"_key_{c}" for c in key])
    else:
        ranked = first_per_group(rows, ["source", "board"], in_board, cap, "round_no", key)
        first = first_per_group(ranked, ["source"], in_source, cap, "slot", key)
    number = F.array_position(F.array(*[F.lit(name) for name in sources]), F.col("source")) - 1
    return cleaned(first, known, *ORDER_COLUMNS, "slot").withColumn("list_no", number.cast("int"))


def capped_source(landed: DataFrame, source: str, boards: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """One source's postings in merged order, up to the cap (``slot``)."""
    listed = None if boards is None else {source: boards}
    return merge_feeds(landed, [source], listed, cap).drop("list_no")
