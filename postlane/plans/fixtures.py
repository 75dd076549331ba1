"""The relations of the engine, derived from the given tables.

Every relation covers its whole table: copies are added and fields are varied by key so
that rules have work to do, but no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import urls
from postlane.operators import scoring, state

TODAY = "1998-08-01"
RUN_DAY = "2024-02-01"
# Words of the tables' texts that stand for remote signals, red flags and skills.
REMOTE_WORDS = ["on", "sur", "auf", "sobre"]
FLAG_WORDS = ["was", "dans", "ist", "para"]
SKILLS = {
    "AUTOMOBILE": ["the", "of", "and", "with", "by"],
    "BUILDING": ["que", "de", "la", "pour"],
    "FURNITURE": ["der", "die", "und", "für", "von", "sch"],
    "HOUSEHOLD": ["the", "de", "der", "el"],
    "MACHINERY": ["that", "this", "it", "from", "is"],
}
DEFAULT_SKILLS = ["the", "de"]
PAGE_CAPS = {"blog.tionsh.example.net": 0, "thther.example.org": 5, "blog.ththan.example.net": 3}
DIFF_RUNS = (199712, 199801)
MERGE_RUN = 199801


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables whose rows take real work, with a key to spread them by.
SPREAD_KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
}


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly row-wise work, dealt evenly by adaptive execution."""
    return table(spark, sf_dir, name).hint("rebalance", *SPREAD_KEYS[name])


# -- pages ------------------------------------------------------------------------


def page_copies(spark, sf_dir) -> DataFrame:
    """Every page as a search hit, and once more under a regional host in the next query."""
    pages = wide_table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("description"),
    )
    copies = F.array(
        F.struct(F.lit(0).alias("copy_no"), F.col("url").alias("url")),
        F.struct(
            F.lit(1).alias("copy_no"),
            F.regexp_replace("url", r"^https?://(www\.)?", "https://uk.").alias("url"),
        ),
    )
    return pages.select("page_id", "title", "description", F.explode(copies).alias("c")).select(
        "page_id",
        "c.copy_no",
        "c.url",
        "title",
        "description",
        F.expr("cast(page_id div 20 + c.copy_no as int)").alias("query_no"),
        F.expr("cast(page_id % 20 * 2 + c.copy_no as int)").alias("place"),
    )


def landed_hits(spark, sf_dir) -> DataFrame:
    """Hit lists as landed: one JSON array per query (each has at most 40 hits)."""
    hit = F.struct("place", F.struct("url", "title", "description").alias("hit"))
    lists = page_copies(spark, sf_dir).groupBy("query_no").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return lists.select("query_no", F.to_json(F.transform("hits", lambda x: x["hit"])).alias("payload"))


def extraction_pages(spark, sf_dir) -> DataFrame:
    """Pages with an extraction result made of their links; some are null, empty or noisy."""
    link = r'<a\s[^>]*?href="([^"]*)"[^>]*>([\s\S]*?)</a>'
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(link), 1).alias("href"),
        F.regexp_extract_all("html", F.lit(link), 2).alias("label"),
    )
    jobs = F.transform(
        pairs,
        lambda x: F.struct(
            F.concat(F.lit("  "), x["label"]).alias("title"),
            F.lit(" Acme ").alias("company"),
            x["href"].alias("url"),
            F.lit("2024-01-15").alias("posted_date"),
            F.concat(F.lit("About "), x["label"]).alias("description"),
        ),
    )
    body = F.substring(F.to_json(jobs), 2, 2_000_000_000)
    kind = F.col("page_id") % 7
    payload = (
        F.when(kind == 0, F.lit("null"))
        .when(kind == 1, F.lit('{"jobs": []}'))
        .when(kind == 2, F.concat(F.lit('{"jobs": ["noise", {"title": "  "}, '), body, F.lit("}")))
        .otherwise(F.concat(F.lit('{"jobs": ['), body, F.lit("}")))
    )
    return wide_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("page_no"),
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("description"),
        payload.alias("payload"),
    )


REFERENCES = ["/abs/x", "rel/x", "?q=1", "#frag", "", "//other.org/z", "https://b.com/y;p?k#f", "../up", "./here"]


def references(spark, sf_dir) -> DataFrame:
    return wide_table(spark, sf_dir, "pages").select(
        "page_id", "url", F.posexplode(F.array(*[F.lit(r) for r in REFERENCES])).alias("ref_no", "ref")
    )


# -- feeds ------------------------------------------------------------------------


def _landed(rows, source, board, fetch, key, item, wrap):
    """Rows gathered into payloads of at most 50 postings, in key order.

    Plain rows are dealt by payload, in one exchange that all feeds of a table share; their
    postings are made behind it and so are never shuffled. ``board`` is a column's name or None.
    """
    by = ["_fetch"] if board is None else [board, "_fetch"]
    dealt = rows.withColumn("_fetch", fetch.cast("long")).repartition(*by)
    gathered = dealt.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(key.alias("k"), item.alias("item")))).alias("items")
    )
    array = F.to_json(F.transform("items", lambda x: x["item"]))
    named = F.lit("") if board is None else F.col(board)
    return gathered.select(
        F.lit(source).alias("source"), named.alias("board"), F.col("_fetch").alias("fetch_no"), wrap(array).alias("payload")
    )


def _object(field):
    return lambda array: F.concat(F.lit(f'{{"{field}": '), array, F.lit("}"))


def _plain(array):
    return array


def _struct(**fields):
    return F.struct(*[F.expr(sql).alias(name) for name, sql in fields.items()])


def landed_remotive(spark, sf_dir):
    item = _struct(
        title="c_name",
        company_name="c_mktsegment",
        candidate_required_location="case when c_nationkey % 5 = 0 then null when c_nationkey % 5 = 1 then '' "
        "else concat('Nation ', c_nationkey) end",
        url="case when c_custkey % 11 = 0 then '' else concat('https://remotive.com/remote-jobs/', c_custkey) end",
        description="concat('<p>', c_name, '</p>')",
        publication_date="concat('2024-05-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0'), 'T12:00:00')",
        salary="case when c_nationkey % 3 = 0 then concat('  $', cast(c_custkey as string), 'k ') end",
    )
    rows = table(spark, sf_dir, "customer")
    return _landed(rows, "remotive.com", None, F.expr("c_custkey div 50"), F.col("c_custkey"), item, _object("jobs"))


def landed_arbeitnow(spark, sf_dir):
    item = _struct(
        title="c_name",
        company_name="c_mktsegment",
        location="case when c_nationkey % 4 > 0 then concat('City ', c_nationkey) end",
        url="concat('https://www.arbeitnow.com/view/', c_custkey)",
        description="c_mktsegment",
        created_at="1714608000 + c_custkey",
    )
    rows = table(spark, sf_dir, "customer")
    return _landed(rows, "arbeitnow.com", None, F.expr("c_custkey div 50"), F.col("c_custkey"), item, _object("data"))


def landed_remoteok(spark, sf_dir):
    item = _struct(
        position="p_name",
        company="p_brand",
        location="case when p_size % 3 > 0 then p_type end",
        url="concat('https://remoteok.com/remote-jobs/', p_partkey)",
        date="concat('2024-05-02T08:00:', lpad(cast(p_partkey % 60 as string), 2, '0'), '+00:00')",
        description="concat('<p>', p_name, '</p><br><p>', p_type, ' role.</p>')",
        salary_min="case when p_size % 5 in (0, 2) then null else p_retailprice end",
        salary_max="case when p_size % 5 in (0, 1) then null when p_size % 5 = 3 then p_retailprice "
        "else p_retailprice * 1.2 end",
    )
    rows = table(spark, sf_dir, "part")

    def with_notice(array):
        return F.concat(F.lit('[{"legal": "terms", "warning": "..."}, '), F.substring(array, 2, 2_000_000_000))

    return _landed(rows, "remoteok.com", None, F.expr("p_partkey div 50"), F.col("p_partkey"), item, with_notice)


def landed_sjs(spark, sf_dir):
    item = _struct(
        uuid="case when p_partkey % 13 = 0 then ' ' else concat('u', p_partkey) end",
        title="concat(' ', p_name, ' ')",
        businessName="concat(p_brand, ' ')",
        areaName="case p_size % 4 when 0 then null when 1 then lower(p_type) else p_name end",
        regionName="case p_size % 4 when 2 then '' else p_type end",
        payMin="cast(p_retailprice / 40 as string)",
        payMax="case when p_size % 2 = 0 then cast(p_retailprice / 20 as string) end",
        payType="case p_size % 3 when 0 then 'hourly' when 1 then 'Annually' else 'voluntary' end",
        summary="p_brand",
        description="case when p_size % 2 = 0 then concat('<p>', p_type, '</p>') end",
        advertStartDateNz="concat('2026-', lpad(cast(p_size % 12 + 1 as string), 2, '0'), '-05T00:00:00.000Z')",
        externalApplyUrl="case when p_size % 5 = 0 then concat('https://apply.example.com/', p_partkey) end",
        applyUrl="case when p_size % 5 = 1 then concat('https://sjs.example.com/', p_partkey) end",
    )
    rows = table(spark, sf_dir, "part")
    return _landed(rows, "sjs.co.nz", None, F.expr("p_partkey div 50"), F.col("p_partkey"), item, _plain)


def landed_adzuna(spark, sf_dir):
    item = F.struct(
        F.col("p_name").alias("title"),
        F.when(F.expr("p_size % 4 > 0"), F.struct(F.col("p_brand").alias("display_name"))).alias("company"),
        F.struct(F.when(F.expr("p_size % 3 > 0"), F.col("p_type")).alias("display_name")).alias("location"),
        *[
            F.expr(sql).alias(name)
            for name, sql in {
                "redirect_url": "concat('https://adzuna.co.nz/r/', p_partkey)",
                "description": "concat(p_name, ' at ', p_brand)",
                "created": "concat('2026-09-', lpad(cast(p_size % 28 + 1 as string), 2, '0'), 'T12:00:00Z')",
                "salary_min": "p_retailprice",
                "salary_max": "p_retailprice * 1.2",
                "salary_is_predicted": "p_size % 2",
            }.items()
        ],
    )
    rows = table(spark, sf_dir, "part")
    return _landed(rows, "adzuna", None, F.expr("p_partkey div 50"), F.col("p_partkey"), item, _object("results"))


def landed_greenhouse(spark, sf_dir):
    escaped = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    item = F.struct(
        F.expr("concat(lang, ' role ', doc_id)").alias("title"),
        F.when(F.expr("doc_id % 3 > 0"), F.concat(F.lit("Co "), F.col("lang"))).alias("company_name"),
        F.expr("concat('https://boards.example.com/', source, '/', doc_id)").alias("absolute_url"),
        F.when(F.expr("doc_id % 4 > 0"), F.struct(F.col("lang").alias("name"))).alias("location"),
        F.expr(f"concat('&lt;p&gt;', {escaped}, '&lt;/p&gt;')").alias("content"),
        F.expr("case when doc_id % 2 = 0 then concat('2026-08-', lpad(cast(doc_id % 28 + 1 as string), 2, '0')) end").alias(
            "first_published"
        ),
        F.expr("concat('2026-07-', lpad(cast(n_chars % 28 + 1 as string), 2, '0'))").alias("updated_at"),
    )
    rows = table(spark, sf_dir, "documents")
    return _landed(rows, "greenhouse", "source", F.expr("doc_id div 1000"), F.col("doc_id"), item, _object("jobs"))


def landed_lever(spark, sf_dir):
    item = F.struct(
        F.expr("concat(lang, ' role ', doc_id)").alias("text"),
        F.expr("case when doc_id % 4 > 0 then concat('https://jobs.lever.example/', source, '/', doc_id) end").alias(
            "hostedUrl"
        ),
        F.expr("concat('https://jobs.lever.example/', source, '/', doc_id, '/apply')").alias("applyUrl"),
        F.expr("cast(1700000000000 + n_chars * 86400000 as string)").alias("createdAt"),
        F.struct(F.when(F.expr("doc_id % 2 = 0"), F.col("lang")).alias("location")).alias("categories"),
        F.expr("case when doc_id % 3 = 0 then text end").alias("descriptionPlain"),
        F.expr("case when doc_id % 3 = 1 then text end").alias("descriptionBodyPlain"),
        F.expr("concat('<div>', text, '</div>')").alias("descriptionBody"),
    )
    rows = table(spark, sf_dir, "documents")
    return _landed(rows, "lever", "source", F.expr("doc_id div 1000"), F.col("doc_id"), item, _plain)


LANDED = {
    "remotive.com": landed_remotive,
    "remoteok.com": landed_remoteok,
    "arbeitnow.com": landed_arbeitnow,
    "sjs.co.nz": landed_sjs,
    "greenhouse": landed_greenhouse,
    "lever": landed_lever,
    "adzuna": landed_adzuna,
}


def landed_feeds(spark, sf_dir) -> DataFrame:
    parts = [make(spark, sf_dir) for make in LANDED.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def landed_with_dead(spark, sf_dir) -> DataFrame:
    """Landed payloads, some of them replaced by an unreadable or a wrong one."""
    dead = (
        F.when(F.col("fetch_no") % 10 == 9, F.lit("not json"))
        .when(F.col("fetch_no") % 10 == 8, F.lit('{"error": "nope"}'))
        .otherwise(F.col("payload"))
    )
    return landed_feeds(spark, sf_dir).withColumn("payload", dead)


# -- sightings and state ------------------------------------------------------------


def sightings(spark, sf_dir) -> DataFrame:
    """Line items as sightings of part postings, one run per month."""
    return wide_table(spark, sf_dir, "lineitem").select(
        F.expr("cast(year(l_shipdate) * 100 + month(l_shipdate) as bigint)").alias("run_id"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("seq"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.expr(
            "concat('https://', case l_linenumber % 3 when 0 then 'www.' when 1 then 'uk.' else '' end, "
            "'jobs.example.com/p/', l_partkey)"
        ).alias("url"),
        F.expr("concat('Part ', l_partkey, ' v', l_linenumber)").alias("title"),
        F.expr("concat('Supplier ', l_suppkey)").alias("company"),
        F.col("l_returnflag").alias("source"),
        F.col("l_linestatus").alias("location"),
        F.expr("case when l_returnflag = 'N' then '' else concat('$', cast(l_quantity as int)) end").alias("salary"),
    )


def document_url() -> str:
    return "concat('https://', source, '.example.com/d/', doc_id)"


def document_postings(spark, sf_dir) -> DataFrame:
    """Documents as postings of one run."""
    return wide_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        "doc_id",
        F.expr("concat(lang, ' role')").alias("title"),
        F.expr("concat('Co ', lang)").alias("company"),
        F.lit("Remote").alias("location"),
        F.expr(document_url()).alias("url"),
        F.col("text").alias("description"),
        F.expr("date_format(date_add(date'2023-12-01', cast(doc_id % 62 as int)), 'yyyy-MM-dd')").alias("posted_date"),
        "source",
        F.expr("case when doc_id % 8 = 1 then concat('$', n_chars) else '' end").alias("salary"),
    )


def label_state(spark, sf_dir) -> DataFrame:
    """Labelled documents as attempted postings; quality 1 has a stored result."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(docs, "doc_id").select(
        urls.dedup_key(F.expr(document_url())).alias("dedup_key"),
        F.expr("case when quality = 1 then '{}' end").alias("data"),
        F.lit(1).cast("long").alias("last_scored_run"),
    )


def batched_inputs(spark, sf_dir) -> DataFrame:
    """Documents in scoring batches; odd and even batches belong to two runs."""
    postings = document_postings(spark, sf_dir)
    return scoring.assign_batches(postings, ["seq"]).withColumn("run_id", F.col("batch") % 2 + 1)


def scorer_results(spark, sf_dir, inputs: DataFrame) -> DataFrame:
    """Results for good documents. Some name no URL, some neither URL nor title."""
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    place = Window.partitionBy("run_id", "batch").orderBy("pos")
    result = F.struct(
        F.expr("case when doc_id % 7 = 0 then '' else title end").alias("title"),
        F.lit("").alias("company"),
        F.expr("case when doc_id % 7 = 0 or doc_id % 3 = 0 then '' else url end").alias("url"),
        F.lit("").alias("location"),
        F.expr("case when doc_id % 4 = 0 then concat('$', doc_id) else '' end").alias("salary"),
        F.expr("case when doc_id % 50 = 49 then 'n/a' else cast(doc_id % 101 as string) end").alias("score"),
        F.expr("case doc_id % 4 when 0 then 'apply' when 1 then 'review' when 2 then 'skip' else 'maybe' end").alias(
            "verdict"
        ),
        F.array().cast("array<string>").alias("match_reasons"),
        F.array().cast("array<string>").alias("red_flags"),
        F.lit("").alias("suggested_angle"),
        F.lit("").alias("source"),
    )
    good = inputs.join(labels, "doc_id").select(
        "run_id", "batch", (F.row_number().over(place) - 1).alias("result_no"), result.alias("r")
    )
    return good.withColumn("data", F.to_json("r"))


def scorer_answers(spark, sf_dir, inputs: DataFrame) -> DataFrame:
    """Raw answers with these results, some of them prose or an object instead of an array."""
    result = F.struct("result_no", "data")
    results = scorer_results(spark, sf_dir, inputs).groupBy("run_id", "batch").agg(
        F.array_sort(F.collect_list(result)).alias("results")
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("results", lambda x: x["data"]), ", "), F.lit("]"))
    array = F.coalesce(listed, F.lit("[]"))
    raw = (
        F.when(F.expr("batch % 7 = 3"), F.lit("Sorry, I cannot do that."))
        .when(F.expr("batch % 7 = 5"), F.concat(F.lit('{"jobs": '), array, F.lit("}")))
        .otherwise(F.concat(F.lit("Here they are:\n"), array))
    )
    batches = inputs.select("run_id", "batch").distinct()
    return batches.join(results, ["run_id", "batch"], "left").select("run_id", "batch", raw.alias("raw"))


def scored_state(spark, sf_dir) -> DataFrame:
    """State after both runs' sightings and scores."""
    inputs = batched_inputs(spark, sf_dir)
    seen = state.sighting_events(inputs.withColumn("day", F.lit(RUN_DAY)))
    before = state.advance_state(None, seen)
    matched = scoring.match_results(scorer_results(spark, sf_dir, inputs), inputs)
    omitted = scoring.omitted_inputs(inputs, matched, inputs.select("run_id", "batch").distinct())
    day = F.concat(F.lit("2024-02-0"), (F.col("run_id") + 1).cast("string"))
    return state.advance_state(before, scoring.score_events(matched, omitted, day))


def scored_documents(spark, sf_dir) -> DataFrame:
    """Labelled documents as scored jobs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("ord"),
        F.expr(document_url()).alias("url"),
        F.expr("case when doc_id % 5 = 0 then '' else concat(lang, ' role ', doc_id) end").alias("title"),
        F.expr("case when doc_id % 6 = 0 then '' else concat('Co ', lang) end").alias("company"),
        F.expr("cast(case when doc_id % 50 = 49 then null else n_chars % 101 end as double)").alias("score"),
    )


# -- runs, attempts, marks ------------------------------------------------------------


def run_events(spark, sf_dir) -> DataFrame:
    """Orders as runs: F finished, O failed, P never finished."""
    kinds = F.array(
        F.struct(F.lit("start").alias("kind"), F.lit(" 08:00:00").alias("clock")),
        F.struct(F.lit("finish").alias("kind"), F.lit(" 09:00:00").alias("clock")),
    )
    done = "kind = 'finish' and o_orderstatus = 'F'"
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey", F.explode(kinds).alias("e"))
        .select("*", "e.kind", "e.clock")
        .where("kind = 'start' or o_orderstatus <> 'P'")
        .select(
            F.col("o_orderkey").alias("run_id"),
            "kind",
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("clock")).alias("at"),
            F.expr("case when kind = 'finish' then case o_orderstatus when 'F' then 'ok' else 'failed' end end").alias(
                "status"
            ),
            F.expr(f"case when {done} then o_custkey end").alias("raw_total"),
            F.expr(f"case when {done} then o_custkey div 2 end").alias("new_count"),
            F.expr(f"case when {done} then o_custkey div 10 end").alias("above_threshold"),
        )
    )


def host_attempts(spark, sf_dir) -> DataFrame:
    """Events as attempts; each user is a host."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        (F.col("event_type") == "error").alias("failed"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "ts",
        "event_id",
    )


ATTEMPT_ORDER = ["ts", "event_id"]


def attempt_chunk():
    return F.date_format("ts", "yyyy-MM-dd HH")


def page_attempts(spark, sf_dir) -> DataFrame:
    """Events as attempts on the host of the page that the user number names."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    return events.join(pages, "user_id").select(
        urls.source_host(F.col("url")).alias("host"),
        (F.col("event_type") == "error").alias("failed"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "ts",
        "event_id",
    )


def tried_pages(spark, sf_dir) -> DataFrame:
    """Consecutive events as the first and second try of a page."""
    status = "400 + cast(get_json_object(props, '$.k') as int) % 30"
    return table(spark, sf_dir, "events").select(
        F.expr("concat('h', (event_id div 2) % 150)").alias("host"),
        F.expr("cast(event_id div 2 as string)").alias("page"),
        F.expr("cast(event_id % 2 as int)").alias("try_no"),
        (F.col("event_type") == "error").alias("failed"),
        F.expr(f"concat('Request failed with HTTP ', {status})").alias("message"),
        F.expr(f"case when user_id % 10 = 4 then 'n/a' when user_id % 2 = 0 then cast({status} as string) end").alias("code"),
        F.expr("case when user_id % 3 > 0 then cast(cast(value as int) as string) end").alias("retry_after"),
    )


def status_marks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://jobs.example.com/c/"), F.col("user_id")).alias("url"),
        F.expr(
            "case event_type when 'purchase' then 'applied' when 'error' then 'skipped' "
            "when 'signup' then 'none' else event_type end"
        ).alias("status"),
        "ts",
        "event_id",
    )


def customer_jobs(spark, sf_dir) -> DataFrame:
    """Customers as scored jobs of the dashboard."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("concat('https://jobs.example.com/c/', c_custkey)").alias("url"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("company"),
        F.expr("concat('Nation ', c_nationkey)").alias("location"),
        F.expr("case when c_nationkey % 4 = 0 then '' else concat('$', c_custkey, ',000-$', c_custkey + 1, ',500') end").alias(
            "salary"
        ),
        F.expr("case when c_custkey % 40 = 39 then null else c_acctbal / 100 end").alias("score"),
        F.expr(
            "case c_mktsegment when 'AUTOMOBILE' then 'apply' when 'BUILDING' then 'review' "
            "when 'FURNITURE' then 'skip' else 'unsure' end"
        ).alias("verdict"),
    )


# -- profiles ---------------------------------------------------------------------------


def profiles(spark, sf_dir) -> DataFrame:
    """Customers as profiles; the segment decides the skills."""
    skills = F.array(*[F.lit(s) for s in DEFAULT_SKILLS])
    for segment, words in SKILLS.items():
        skills = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(w) for w in words])).otherwise(skills)
    return wide_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        skills.alias("skills"),
        F.expr("array(concat(initcap(c_mktsegment), ' Analyst'), initcap(c_mktsegment))").alias("roles"),
    )


def search_config() -> dict:
    return settings.source_config()


def defective_plans(plans: DataFrame) -> DataFrame:
    """Search plans with missing, repeated, unknown and incomplete queries."""
    k = F.col("profile_id") + F.col("query_no")
    repeat = F.when(k % 19 == 0, 2).when(k % 17 == 0, 0).otherwise(1)
    return (
        plans.withColumn("copies", F.sequence(F.lit(0), repeat))
        .withColumn("copy_no", F.explode("copies"))
        .where(F.col("copy_no") > 0)
        .withColumn("query", F.when(k % 23 == 0, F.replace("query", F.lit("remote"), F.lit("onsite"))).otherwise(F.col("query")))
        .withColumn("target", F.when(k % 29 == 0, F.lit("elsewhere.com")).otherwise(F.col("target")))
        .select("profile_id", "kind", "target", "query")
    )
