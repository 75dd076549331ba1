"""SQL twins of the registered queries, over the given tables.

They compute the expected rows straight from the columns (no payloads, no folds of the
engine), in DuckDB's dialect.
"""

from __future__ import annotations

from postlane.plans import fixtures as fx
from postlane.settings import DEFAULT_SOURCES

ORACLE: dict[str, str] = {}

# -- snippets ---------------------------------------------------------------------------

URL = (
    r"'^[\x00-\x20]*(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$'"
)
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def netloc(url):
    return f"regexp_extract({url}, {URL}, 2)"


def canonical(host):
    bare = f"regexp_replace(lower({host}), '^www\\.', '')"
    return f"regexp_replace({bare}, '^[^.]{{2}}\\.([^.]*\\.)', '\\1')"


def host_of(url):
    return canonical(netloc(url))


def key_of(url):
    path = f"regexp_replace(regexp_extract({url}, {URL}, 3), ';[^/]*$', '')"
    return f"{host_of(url)} || {path} || '?' || regexp_extract({url}, {URL}, 4)"


def strip_tags(c):
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))"


def unescape(c):
    for name, value in {
        "lt": "<", "gt": ">", "quot": '"', "#39": "''", "apos": "''", "nbsp": " ", "copy": "©", "middot": "·",
    }.items():
        c = f"replace({c}, '&{name};', '{value}')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def strip(c):
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def money(c, places):
    return f"'$' || format('{{:,.{places}f}}', {c})"


def pay_range(low, high, places):
    return (
        f"case when {low} <= 0 and {high} <= 0 then '' "
        f"when {low} > 0 and {high} > 0 and {low} <> {high} then {money(low, places)} || '-' || {money(high, places)} "
        f"when {high} > 0 then {money(high, places)} else {money(low, places)} end"
    )


PAGE_COPIES = r"""
  select page_id, copy_no, url, title, description,
         (page_id // 20 + copy_no)::int as query_no, (page_id % 20 * 2 + copy_no)::int as place
  from (
    select page_id, 0 as copy_no, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
           regexp_extract(html, '<h1>([^<]*)</h1>', 1) as description from pages
    union all
    select page_id, 1, regexp_replace(url, '^https?://(www\.)?', 'https://uk.'),
           regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(html, '<h1>([^<]*)</h1>', 1) from pages
  )"""

ANCHORS = r"""
  select page_id, url as page_url, unnest(range(len(hrefs))) as pos, unnest(hrefs) as href, unnest(labels) as label
  from (
    select page_id, url,
           regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>((?s:.*?))</a>', 1) as hrefs,
           regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>((?s:.*?))</a>', 2) as labels
    from pages
  )"""
ORIGIN = "regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1)"

DOC_URL = "'https://' || source || '.example.com/d/' || doc_id"
DOC_KEY = "source || '.example.com/d/' || doc_id || '?'"
DOCS = f"""
  select doc_id, lang || ' role' as title, 'Co ' || lang as company, {DOC_URL} as url, {DOC_KEY} as dedup_key,
         text as description, source, (date '2023-12-01' + (doc_id % 62)::int)::date as posted,
         case when doc_id % 8 = 1 then '$' || n_chars else '' end as salary
  from documents"""

SIGHTINGS = """
  select (year(l_shipdate) * 100 + month(l_shipdate))::bigint as run_id, l_orderkey * 8 + l_linenumber as seq,
         strftime(l_shipdate, '%Y-%m-%d') as day, 'jobs.example.com/p/' || l_partkey || '?' as dedup_key,
         'https://' || case l_linenumber % 3 when 0 then 'www.' when 1 then 'uk.' else '' end
           || 'jobs.example.com/p/' || l_partkey as url,
         'Part ' || l_partkey || ' v' || l_linenumber as title, 'Supplier ' || l_suppkey as company,
         l_returnflag as source, l_linestatus as location, l_linenumber as line,
         case when l_returnflag = 'N' then '' else '$' || floor(l_quantity)::int end as salary
  from lineitem"""

SEEN_STATE = f"""
  with s as (select *, run_id * 1000000000 + seq as place from ({SIGHTINGS}))
  select dedup_key, arg_min(url, place) as url, arg_max(title, place) as title, arg_max(company, place) as company,
         arg_max(source, place) as source, arg_max(location, place) as location,
         coalesce(arg_max(salary, place) filter (salary <> ''), arg_min(salary, place)) as salary,
         arg_min(day, place) as first_seen, arg_max(day, place) as last_seen, count(*) as runs_seen,
         min(run_id) as first_seen_run, max(run_id) as last_seen_run
  from s group by dedup_key"""

# Attempts as hosts' streaks; needs a relation `a(host, failed, ts, event_id)`.
STREAKS = """
  g as (select *, sum(case when failed then 0 else 1 end) over (partition by host order by ts, event_id
                rows unbounded preceding) as island from a),
  f as (select host, island, ts, row_number() over (partition by host, island order by ts, event_id) as k
        from g where failed),
  hit as (select host, min(ts) as hit_ts from f where k = 3 group by host),
  tail as (select f.host, count(*) as n, max(f.ts) as last_ts from f
           join (select host, max(island) as island from g group by host) m using (host, island) group by f.host),
  streaks as (
    select host, 3::bigint as consecutive_failures, strftime(hit_ts, '%Y-%m-%d') as last_failure, true as demoted from hit
    union all
    select host, n, strftime(last_ts, '%Y-%m-%d'), false from tail where host not in (select host from hit))"""

# -- functions ----------------------------------------------------------------------------

ORACLE["canonical_host"] = f"""
  select netloc, {canonical('netloc')} as host, n
  from (select {netloc('url')} as netloc, count(*) as n from ({PAGE_COPIES}) group by 1)"""

ORACLE["dedup_key"] = f"select page_id, copy_no, url, {key_of('url')} as dedup_key from ({PAGE_COPIES})"

_refs = ", ".join(f"({i}, '{r}')" for i, r in enumerate(fx.REFERENCES))
ORACLE["resolve_url"] = f"""
  with p as (select page_id, url, regexp_extract(url, '^([a-z]+:)', 1) as scheme,
                    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin,
                    regexp_extract(url, {URL}, 3) as path, regexp_extract(url, {URL}, 4) as query from pages),
  q as (select *, regexp_extract(path, '^(.*/)', 1) as dir from p)
  select page_id, ref_no, case ref
      when '/abs/x' then origin || '/abs/x'
      when 'rel/x' then origin || dir || 'rel/x'
      when '?q=1' then origin || path || '?q=1'
      when '#frag' then origin || path || case when query <> '' then '?' || query else '' end || '#frag'
      when '' then url
      when '//other.org/z' then scheme || '//other.org/z'
      when '../up' then origin || regexp_replace(dir, '[^/]+/$', '') || 'up'
      when './here' then origin || dir || 'here'
      else case when scheme = 'https:' then 'https://b.com/y;p?k#f' else 'https://b.com/y;p?k#f' end
    end as resolved
  from q cross join (values {_refs}) t(ref_no, ref)"""

for _name, _expr in {
    "strip_html": strip_tags("html"),
    "html_unescape": unescape("html"),
    "html_to_text": unescape(strip_tags(unescape("html"))),
}.items():
    ORACLE[_name] = f"""
      select page_id, length(t)::bigint as n_chars, md5(t) as md5 from (select page_id, {_expr} as t from pages)"""

_BOUNDS = """
  select p_partkey, case when p_size % 5 in (0, 2) then 0.0 else p_retailprice end as lo,
         case when p_size % 5 in (0, 1) then 0.0 when p_size % 5 = 3 then p_retailprice else p_retailprice * 1.2 end as hi
  from part"""
_RANGE = f"select p_partkey, {pay_range('lo', 'hi', 0)} as salary from ({_BOUNDS})"
ORACLE["salary_range_text"] = _RANGE

_PAY = "select p_partkey, p_size, p_retailprice / 40 as lo, case when p_size % 3 > 0 then p_retailprice / 20 else 0.0 end as hi from part"
ORACLE["pay_text"] = f"""
  select p_partkey, case p_size % 4 when 0 then ({pay_range('lo', 'hi', 2)}) || '/hr'
      when 1 then ({pay_range('lo', 'hi', 0)}) || '/yr' when 2 then ({pay_range('lo', 'hi', 0)}) || '/mo'
      else {pay_range('lo', 'hi', 2)} end as pay
  from ({_PAY})"""

ORACLE["place_text"] = """
  select c_custkey, case c_custkey % 4 when 0 then r_name when 1 then r_name when 2 then 'New Zealand'
      else n_name || ', ' || r_name end as place
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

ORACLE["epoch_ms_to_date"] = """
  select event_id, case when event_type = 'view' then 'soon' else strftime(ts, '%Y-%m-%d') end as day from events"""

ORACLE["salary_value"] = f"""
  select p_partkey, coalesce(list_max([x::double for x in
      regexp_extract_all(replace(salary, ',', ''), '[0-9]+(?:\\.[0-9]+)?')]), 0.0) as salary_value
  from ({_RANGE})"""

ORACLE["score_cast"] = """
  select event_id, case event_id % 5 when 0 then trunc(value) when 4 then case when value <= -1 then trunc(value) - 0.5
      else trunc(value) + 0.5 end end as score from events"""

CUSTOMER_JOBS = """
  select c_custkey, 'https://jobs.example.com/c/' || c_custkey as url, c_name as title,
         case when c_nationkey % 4 = 0 then '' else '$' || c_custkey || ',000-$' || (c_custkey + 1) || ',500' end as salary,
         case when c_custkey % 40 = 39 then null else c_acctbal / 100 end as score,
         case c_mktsegment when 'AUTOMOBILE' then 'apply' when 'BUILDING' then 'review' when 'FURNITURE' then 'skip'
           else 'unsure' end as verdict
  from customer"""
ORACLE["score_bands"] = f"""
  select case when coalesce(score, 0) >= 80 then 'high' when coalesce(score, 0) >= 60 then 'mid' else 'low' end as band,
         case when verdict in ('apply', 'review', 'skip') then verdict else 'other' end as verdict_class, count(*) as n
  from ({CUSTOMER_JOBS}) group by 1, 2"""

ORACLE["freshness_flag"] = f"""
  select o_orderkey, datediff('day', o_orderdate::date, date '{fx.TODAY}') <= 30 as fresh from orders"""

ORACLE["attempt_classify"] = """
  with t as (
    select 'h' || ((event_id // 2) % 150) as host, (event_id // 2)::varchar as page, (event_id % 2)::int as try_no,
           event_type = 'error' as failed, 400 + json_extract_string(props, '$.k')::int % 30 as status,
           user_id % 2 = 0 as has_code, user_id % 10 = 4 as bad_code, case when user_id % 3 > 0 then trunc(value)::int end as wait, event_id,
           (select max(event_id) from events) as last_id
    from events),
  s as (select *, case when failed and not bad_code and (has_code or status // 10 in (40, 42)) then status end as http_status from t)
  select host, page, try_no, http_status,
         case when not failed then 'ok' when http_status = 402 then 'abort'
              when http_status = 429 and try_no = 0 and event_id < last_id then 'retry' else 'fail' end as outcome,
         case when failed and http_status = 429 and try_no = 0 and event_id < last_id
              then case when wait is null then 20 else greatest(0, least(wait, 60)) end::double end as wait_s
  from s"""

ORACLE["parse_model_output"] = """
  select doc_id, 0 as result_no, md5(text) as title_md5, (doc_id % 101)::double as score from documents where doc_id % 5 < 4"""
ORACLE["unreadable_answers"] = "select doc_id from documents where doc_id % 5 = 4"

# -- feeds ------------------------------------------------------------------------------------

REMOTIVE = """
  select '' as board, c_custkey // 50 as fetch_no, (c_custkey % 50)::int as pos, c_name as title, c_mktsegment as company,
         case when c_nationkey % 5 < 2 then 'Remote' else 'Nation ' || c_nationkey end as location,
         'https://remotive.com/remote-jobs/' || c_custkey as url, '<p>' || c_name || '</p>' as description,
         '2024-05-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0') || 'T12:00:00' as posted_date,
         'remotive.com' as source, case when c_nationkey % 3 = 0 then '$' || c_custkey || 'k' else '' end as salary
  from customer where c_custkey % 11 > 0"""
REMOTEOK = f"""
  select '' as board, p_partkey // 50 as fetch_no, (p_partkey % 50 + 1)::int as pos, p_name as title, p_brand as company,
         case when p_size % 3 > 0 then p_type else 'Remote' end as location,
         'https://remoteok.com/remote-jobs/' || p_partkey as url, p_name || ' ' || p_type || ' role.' as description,
         '2024-05-02T08:00:' || lpad((p_partkey % 60)::varchar, 2, '0') || '+00:00' as posted_date,
         'remoteok.com' as source, salary
  from part join ({_RANGE}) using (p_partkey)"""
ARBEITNOW = """
  select '' as board, c_custkey // 50 as fetch_no, (c_custkey % 50)::int as pos, c_name as title, c_mktsegment as company,
         case when c_nationkey % 4 > 0 then 'City ' || c_nationkey else 'Remote' end as location,
         'https://www.arbeitnow.com/view/' || c_custkey as url, c_mktsegment as description,
         (1714608000 + c_custkey)::varchar as posted_date, 'arbeitnow.com' as source, '(none)' as salary
  from customer"""
_SJS_PAY = "select *, p_retailprice / 40 as lo, case when p_size % 2 = 0 then p_retailprice / 20 else 0.0 end as hi from part"
SJS = f"""
  select '' as board, p_partkey // 50 as fetch_no, (p_partkey % 50)::int as pos, p_name as title, p_brand as company,
         case p_size % 4 when 0 then p_type when 1 then p_type when 2 then p_name else p_name || ', ' || p_type end as location,
         case p_size % 5 when 0 then 'https://apply.example.com/' || p_partkey
              when 1 then 'https://sjs.example.com/' || p_partkey
              else 'https://www.sjs.co.nz/job-seeker/jobs/u' || p_partkey end as url,
         p_brand || case when p_size % 2 = 0 then ' — ' || p_type else '' end as description,
         '2026-' || lpad((p_size % 12 + 1)::varchar, 2, '0') || '-05T00:00:00.000Z' as posted_date, 'sjs.co.nz' as source,
         case p_size % 3 when 0 then ({pay_range('lo', 'hi', 2)}) || '/hr' when 1 then ({pay_range('lo', 'hi', 0)}) || '/yr'
              else {pay_range('lo', 'hi', 2)} end as salary
  from ({_SJS_PAY}) where p_partkey % 13 > 0"""
ADZUNA = f"""
  select '' as board, p_partkey // 50 as fetch_no, (p_partkey % 50)::int as pos, p_name as title,
         case when p_size % 4 > 0 then p_brand else '' end as company,
         case when p_size % 3 > 0 then p_type else '' end as location, 'https://adzuna.co.nz/r/' || p_partkey as url,
         p_name || ' at ' || p_brand as description,
         '2026-09-' || lpad((p_size % 28 + 1)::varchar, 2, '0') || 'T12:00:00Z' as posted_date, 'adzuna' as source,
         ({pay_range('p_retailprice', 'p_retailprice * 1.2', 0)}) || case when p_size % 2 = 1 then ' (est.)' else '' end as salary
  from part"""
_BOARD = "row_number() over (partition by source, doc_id // 1000 order by doc_id) - 1"
GREENHOUSE = f"""
  select source as board, doc_id // 1000 as fetch_no, ({_BOARD})::int as pos, lang || ' role ' || doc_id as title,
         case when doc_id % 3 > 0 then 'Co ' || lang else source end as company,
         case when doc_id % 4 > 0 then lang else '' end as location,
         'https://boards.example.com/' || source || '/' || doc_id as url,
         {unescape(strip_tags("'<p>' || text || '</p>'"))} as description,
         case when doc_id % 2 = 0 then '2026-08-' || lpad((doc_id % 28 + 1)::varchar, 2, '0')
              else '2026-07-' || lpad((n_chars % 28 + 1)::varchar, 2, '0') end as posted_date,
         'greenhouse' as source, '' as salary
  from documents"""
LEVER = f"""
  select source as board, doc_id // 1000 as fetch_no, ({_BOARD})::int as pos, lang || ' role ' || doc_id as title,
         source as company, case when doc_id % 2 = 0 then lang else '' end as location,
         'https://jobs.lever.example/' || source || '/' || doc_id || case when doc_id % 4 > 0 then '' else '/apply' end as url,
         case when doc_id % 3 < 2 then text else {unescape(strip_tags(unescape("'<div>' || text || '</div>'")))} end as description,
         strftime(to_timestamp(1700000000 + n_chars * 86400) at time zone 'UTC', '%Y-%m-%d') as posted_date,
         'lever' as source, '' as salary
  from documents"""
ORACLE["norm_remotive"] = REMOTIVE
ORACLE["norm_remoteok"] = REMOTEOK
ORACLE["norm_arbeitnow"] = ARBEITNOW
ORACLE["norm_sjs"] = SJS
ORACLE["norm_adzuna"] = ADZUNA
for _name, _sql in {"norm_greenhouse": GREENHOUSE, "norm_lever": LEVER}.items():
    ORACLE[_name] = f"select * exclude (description), md5(description) as description_md5 from ({_sql})"

FEEDS = [REMOTIVE, REMOTEOK, ARBEITNOW, SJS, GREENHOUSE, LEVER, ADZUNA]
LANDED_COUNTS = """
    select 'remotive.com' as source, '' as board, c_custkey // 50 as fetch_no, count(*) as n from customer group by all
    union all select 'arbeitnow.com', '', c_custkey // 50, count(*) from customer group by all
    union all select 'remoteok.com', '', p_partkey // 50, count(*) + 1 from part group by all
    union all select 'sjs.co.nz', '', p_partkey // 50, count(*) from part group by all
    union all select 'adzuna', '', p_partkey // 50, count(*) from part group by all
    union all select 'greenhouse', source, doc_id // 1000, count(*) from documents group by all
    union all select 'lever', source, doc_id // 1000, count(*) from documents group by all"""

ORACLE["feed_scan_quarantine"] = f"""
  with p as ({LANDED_COUNTS})
  select source, count(*) as n_payloads, count(*) filter (fetch_no % 10 >= 8) as n_dead,
         coalesce(sum(n) filter (fetch_no % 10 < 8), 0)::bigint as n_elements
  from p group by source"""

ORACLE["feed_faults"] = f"""
  with p as ({LANDED_COUNTS})
  select source, case fetch_no % 10 when 9 then 'not JSON' when 8 then 'no array' else 'sound' end as reason,
         case when fetch_no % 10 <> 8 then '' when source in ('remotive.com', 'greenhouse') then '$.jobs'
              when source = 'arbeitnow.com' then '$.data' when source = 'adzuna' then '$.results' else '$' end as path,
         count(*) as n_payloads, min(fetch_no) as first_fetch_no
  from p group by all"""


def _capped(number, sql, cap):
    """The first of one source in its merged order."""
    if number in (4, 5):
        boards = f"""select *, row_number() over (partition by board order by posted_date desc, fetch_no, pos) as round_no
                     from ({sql})"""
        order, source = "round_no, board", f"select * from ({boards}) where round_no <= {cap}"
    else:
        order = "posted_date desc, fetch_no, pos" if number == 3 else "fetch_no, pos"
        source = sql
    return f"""
      select {number} as list_no, slot::int as slot, source, url, title, posted_date
      from (select *, row_number() over (order by {order}) as slot from ({source})) where slot <= {cap}"""


ORACLE["feeds_merge_capped"] = " union all ".join(_capped(i, sql, 50) for i, sql in enumerate(FEEDS))
ORACLE["feeds_merge"] = " union all ".join(_capped(i, sql, 1_000_000_000) for i, sql in enumerate(FEEDS))
ORACLE["interleave_boards"] = f"""
  select board, round_no::int as round_no, url, posted_date
  from (select *, row_number() over (partition by board order by posted_date desc, fetch_no, pos) as round_no
        from ({GREENHOUSE}))"""

ANCHOR_POSTINGS = f"""
  select page_id, pos::int as pos, {unescape(strip_tags(unescape('label')))} as title, 'Remote' as location,
         {ORIGIN} || {unescape('href')} as url, {host_of('page_url')} as source
  from ({ANCHORS})"""
ORACLE["page_anchor_postings"] = f"select * from ({ANCHOR_POSTINGS}) where title <> ''"
_ALL = " union all ".join(
    [f"select source, url, '(none)' as salary from ({ANCHOR_POSTINGS}) where title <> ''"]
    + [f"select source, url, salary from ({sql})" for sql in FEEDS]
)
ORACLE["raw_union"] = _ALL
ORACLE["rows_per_source"] = f"select source, count(*) as n from ({_ALL}) group by source"

# -- search hits and pages --------------------------------------------------------------------

ALL_HITS = f"""
  select query_no, hit_no::int as hit_no, url, title, description
  from (select *, row_number() over (partition by query_no order by place) - 1 as hit_no from ({PAGE_COPIES}))"""
HITS = f"select * from ({ALL_HITS}) where hit_no < 10"
ORACLE["hits_scan"] = HITS
ORACLE["dedupe_first_wins"] = f"""
  select dedup_key, query_no, place, url
  from (select *, row_number() over (partition by dedup_key order by query_no, place) as n
        from (select *, {key_of('url')} as dedup_key from ({PAGE_COPIES}))) where n = 1"""


def _discovered(hits):
    return f"""
  select row_number() over (partition by query_no order by hit_no)::int as round_no, query_no, dedup_key, url
  from (select *, row_number() over (partition by dedup_key order by query_no, hit_no) as n
        from (select *, {key_of('url')} as dedup_key from ({hits}))) where n = 1"""


ORACLE["interleave_hits"] = _discovered(ALL_HITS)
ORACLE["pages_per_host"] = f"select {host_of('url')} as host, count(*) as n from pages group by 1"
_caps = ", ".join(f"('{h}', {c})" for h, c in {**DEFAULT_SOURCES["scrape_caps"], **fx.PAGE_CAPS}.items())
ORACLE["host_caps_apply"] = f"""
  select page_id, host, host_rank::int as host_rank, cap
  from (select page_id, host, coalesce(cap, 20) as cap, row_number() over (partition by host order by page_id) as host_rank
        from (select page_id, {host_of('url')} as host from pages) left join (values {_caps}) c(host, cap) using (host))
  where host_rank <= cap"""


def _fetch_plan(hits, cap, budget):
    return f"""
  with a as (select {host_of('url')} as host, event_type = 'error' as failed, ts, event_id
             from events join pages on user_id = page_id),
  {STREAKS},
  d as (select *, {host_of('url')} as host from ({_discovered(hits)})),
  c as (select * from (
          select d.*, coalesce(cap, {cap}) as cap, row_number() over (partition by d.host order by round_no, query_no) as host_rank
          from d left join (values {_caps}) c(host, cap) using (host)) where host_rank <= cap),
  t as (select * from c order by round_no, query_no limit {budget})
  select round_no, query_no, url, t.host, coalesce(consecutive_failures, 0) as consecutive_failures,
         case when t.host in ('linkedin.com', 'reddit.com') or consecutive_failures >= 3 then 'snippet' else 'scrape' end as action
  from t left join streaks using (host)"""


ORACLE["fetch_plan"] = _fetch_plan(HITS, 20, 20)
ORACLE["fetch_plan_all"] = _fetch_plan(ALL_HITS, 1_000_000_000, 1_000_000_000)
ORACLE["extract_postings"] = f"""
  select page_id as page_no, (pos + case when page_id % 7 = 2 then 2 else 0 end)::int as pos, {strip('label')} as title,
         'Acme' as company, 'Remote' as location, {ORIGIN} || href as url, {strip("'About ' || label")} as description,
         '2024-01-15' as posted_date, {host_of('page_url')} as source
  from ({ANCHORS}) where page_id % 7 > 1 and {strip('label')} <> ''
  union all
  select page_id, 0, regexp_extract(html, '<title>([^<]*)</title>', 1), '', 'Remote', url,
         regexp_extract(html, '<h1>([^<]*)</h1>', 1), '', {host_of('url')}
  from pages where page_id % 7 <= 1
     or page_id not in (select page_id from ({ANCHORS}) where {strip('label')} <> '')"""

# -- state --------------------------------------------------------------------------------------

ORACLE["seen_fold"] = SEEN_STATE
ORACLE["seen_upsert"] = SEEN_STATE
ORACLE["seen_export"] = f"select dedup_key, url, title, first_seen, last_seen, runs_seen from ({SEEN_STATE})"
ORACLE["partition_new"] = f"select doc_id, dedup_key from ({DOCS}) where doc_id not in (select doc_id from labels)"
ORACLE["partition_already"] = f"select doc_id, dedup_key from ({DOCS}) where doc_id in (select doc_id from labels)"
ORACLE["partition_check"] = """
  select count(*) as n_all, count(*) filter (not known) as n_new, count(*) filter (known) as n_already
  from (select doc_id in (select doc_id from labels) as known from documents)"""
RUNS = """
  select run_id, started_at,
         case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') || ' 09:00:00' else next_start end as finished_at,
         case o_orderstatus when 'F' then 'ok' when 'O' then 'failed'
              else case when next_start is null then 'running' else 'failed' end end as status,
         case when o_orderstatus = 'F' then o_custkey end as raw_total,
         case when o_orderstatus = 'F' then o_custkey // 2 end as new_count,
         case when o_orderstatus = 'F' then o_custkey // 10 end as above_threshold
  from (select o_orderkey as run_id, strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00' as started_at, o_orderstatus,
               o_orderdate, o_custkey,
               lead(strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00') over (order by o_orderkey) as next_start from orders)"""
ORACLE["runs_fold"] = RUNS
ORACLE["run_history"] = f"select * from ({RUNS}) order by run_id desc limit 20"
MARKS = """
  select 'https://jobs.example.com/c/' || user_id as url, event_id, ts,
         case event_type when 'purchase' then 'applied' when 'error' then 'skipped' when 'signup' then 'none'
           else event_type end as status from events"""
LATEST = f"""
  select url, status from (
    select *, row_number() over (partition by url order by ts desc, event_id desc) as n
    from ({MARKS}) where status in ('applied', 'skipped', 'none')) where n = 1 and status <> 'none'"""
ORACLE["status_latest"] = LATEST
ORACLE["status_rejects"] = f"select event_id, url, status from ({MARKS}) where status not in ('applied', 'skipped', 'none')"
ORACLE["bootstrap_import"] = f"""
  with seen as (select dedup_key, url, title, quality from ({DOCS}) join labels using (doc_id)),
  scored as (select *, case when doc_id % 10 = 0 then null else (doc_id % 101)::double end as score
             from ({DOCS}) where doc_id % 9 > 0)
  select coalesce(s.dedup_key, c.dedup_key) as dedup_key, coalesce(s.url, c.url) as url, coalesce(s.title, c.title) as title,
         case when s.url is not null then '(none)' else c.company end as company, c.score,
         case when c.url is null then '(none)' else '{{}}' end as data,
         case when s.url is not null then '2024-01-01' else '2024-02-01' end as first_seen,
         case when s.url is not null then '2024-01-05' else '2024-02-01' end as last_seen,
         case when s.url is not null then s.quality + 2 else 1 end::bigint as runs_seen
  from seen s full outer join scored c using (dedup_key)"""

# -- scoring --------------------------------------------------------------------------------------

BATCHED = f"""
  select *, idx // 10 as batch, (idx % 10)::int as pos, (idx // 10) % 2 + 1 as run_id
  from (select *, row_number() over (order by doc_id) - 1 as idx from ({DOCS}))"""
ORACLE["score_batches"] = f"select doc_id, idx, batch, pos, run_id from ({BATCHED})"
ORACLE["batch_payloads"] = f"""
  select run_id, batch, count(*)::int as n_postings, string_agg(url, ' ' order by pos) as urls,
         md5(string_agg(description, '|' order by pos)) as descriptions_md5
  from ({BATCHED}) group by run_id, batch"""
ORACLE["score_batches_stub"] = f"""
  select run_id, batch, (row_number() over (partition by run_id, batch order by pos) - 1)::int as result_no, url,
         (60 + length(description) % 41)::double as score
  from ({BATCHED}) where 60 + length(description) % 41 >= 70"""
MATCHED = f"""
  b as ({BATCHED}),
  r as (select b.*, row_number() over (partition by run_id, batch order by pos) - 1 as result_no,
               case when doc_id % 7 = 0 then '' else title end as r_title,
               case when doc_id % 7 = 0 or doc_id % 3 = 0 then '' else url end as r_url
        from b where doc_id in (select doc_id from labels where quality = 1)),
  t as (select run_id, batch, title, min(pos) as pos from b group by all),
  m as (select r.*, case when r_url <> '' then 'url' when r_title <> '' then 'title' else 'position' end as tier,
               case when r_url <> '' then r.pos when r_title <> '' then t.pos else r.result_no end as input_pos
        from r left join t using (run_id, batch, title)),
  matched as (
    select m.run_id, m.batch, m.result_no::int as result_no, m.tier, m.input_pos::int as input_pos, i.dedup_key,
           case when r_title <> '' then r_title else i.title end as title,
           case when m.doc_id % 4 = 0 then '$' || m.doc_id else i.salary end as salary,
           case when m.doc_id % 50 = 49 then null else (m.doc_id % 101)::double end as score,
           case m.doc_id % 4 when 0 then 'apply' when 1 then 'review' when 2 then 'skip' else 'maybe' end as verdict
    from m join b i on i.run_id = m.run_id and i.batch = m.batch and i.pos = m.input_pos)"""
ORACLE["score_match"] = f"with {MATCHED} select * from matched"
ORACLE["omitted_inputs"] = f"""
  with {MATCHED}
  select run_id, batch, pos, dedup_key from b
  where batch % 7 not in (3, 5) and (run_id, batch, dedup_key) not in (select (run_id, batch, dedup_key) from matched)"""
ORACLE["answers_to_retry"] = f"select distinct run_id, batch from ({BATCHED}) where batch % 7 in (3, 5)"
SCORED_STATE = f"""
  with {MATCHED},
  l as (select * from (select *, row_number() over (partition by dedup_key order by result_no desc) as n from matched) where n = 1),
  pay as (select dedup_key, max_by(salary, result_no) as salary from matched where salary <> '' group by dedup_key)
  select b.dedup_key, b.doc_id, coalesce(l.title, b.title) as title, coalesce(pay.salary, b.salary) as salary, l.score,
         l.verdict, '{fx.RUN_DAY}' as first_seen, '2024-02-0' || (b.run_id + 1) as last_seen, 1::bigint as runs_seen,
         b.run_id as last_seen_run, b.run_id as last_scored_run, l.dedup_key is not null as has_data, b.run_id
  from b left join l using (dedup_key) left join pay using (dedup_key)"""
ORACLE["score_upsert"] = f"select * exclude (doc_id, run_id) from ({SCORED_STATE})"
_export = f"select dedup_key, score, run_id as first_seen_run, doc_id as first_seq from ({SCORED_STATE}) where has_data"
ORACLE["scored_export"] = _export
ORACLE["scored_export_run"] = f"select * from ({_export}) where first_seen_run = 2"
ORACLE["resume_plan"] = f"""
  with b as ({BATCHED})
  select doc_id, batch, dedup_key from b
  where batch not in (select batch from b join labels using (doc_id) where quality = 0)"""
ORACLE["score_contract_violations"] = f"""
  with r as (
    select doc_id, case when doc_id % 13 = 0 then null else (doc_id % 120)::double end as score,
           case doc_id % 5 when 0 then 'apply' when 1 then 'review' when 2 then 'skip' when 3 then 'maybe' end as verdict,
           case doc_id % 4 when 0 then '' when 1 then '$9' when 2 then split_part(description, ' ', 1) else '$1,000,000' end as stated,
           salary, description
    from ({DOCS}))
  select doc_id, 'score_range' as rule from r where score is null or score not between 0 and 100
  union all select doc_id, 'below_threshold' from r where score < 70
  union all select doc_id, 'verdict' from r where verdict is null or verdict = 'maybe'
  union all select doc_id, 'salary_not_in_input' from r
    where stated <> '' and not contains(salary, stated) and not contains(description, stated)"""


def _words(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FEATURES = f"""
  select doc_id, words, list_has_any(words, {_words(fx.REMOTE_WORDS)}) as remote,
         datediff('day', posted, date '{fx.RUN_DAY}') <= 30 as fresh,
         list_sort(list_intersect(words, {_words(fx.FLAG_WORDS)})) as flags
  from (select doc_id, posted,
               list_distinct(regexp_split_to_array(lower(title || ' ' || description), '[^\\pL\\pN+#]+')) as words
        from ({DOCS}))"""
_base = "remote::int * 20 + fresh::int * 20 - len(flags) * 10"
_skills = fx.SKILLS["AUTOMOBILE"]
ORACLE["feature_score"] = f"""
  select doc_id, score, case when score >= 80 then 'apply' when score >= 60 then 'review' else 'skip' end as verdict, remote, fresh,
         array_to_string(reasons, ' ') as match_reasons, array_to_string(flags, ' ') as red_flags
  from (select *, round(greatest(0.0, least(100.0, 60.0 * len(reasons) / {len(_skills)} + {_base})), 4)::double as score
        from (select *, list_sort(list_intersect(words, {_words(_skills)})) as reasons from ({FEATURES})))"""
_sets = " ".join(f"when '{k}' then {_words(v)}" for k, v in fx.SKILLS.items())
ORACLE["profile_top_matches"] = f"""
  with f as ({FEATURES}),
  p as (select c_custkey as profile_id, c_mktsegment as seg,
               case c_mktsegment {_sets} else {_words(fx.DEFAULT_SKILLS)} end as skills from customer),
  s as (select seg, any_value(skills) as skills from p group by seg),
  c as (select seg, doc_id, len(list_intersect(words, skills))::bigint as n_shared, len(skills) as wanted, {_base} as base from f, s),
  x as (select seg, doc_id, n_shared, round(greatest(0.0, least(100.0, 60.0 * n_shared / wanted + base)), 4)::double as score
        from c where n_shared > 0),
  t as (select *, row_number() over (partition by seg order by score desc, doc_id)::int as place from x)
  select profile_id, doc_id, n_shared, score, place from p join t using (seg) where place <= 5"""

# -- search plans -----------------------------------------------------------------------------------

_targets = [("board", b, f"site:{b}", "") for b in DEFAULT_SOURCES["job_boards"]] + [
    ("group", g["name"], "(" + " OR ".join(f"site:reddit.com/r/{s}" for s in g["subreddits"]) + ")", g.get("extra_terms", ""))
    for g in DEFAULT_SOURCES["reddit_groups"]
]
_values = ", ".join(f"({i}, '{k}', '{t}', '{s}', '{e}')" for i, (k, t, s, e) in enumerate(_targets))
PLAN = f"""
  select c_custkey as profile_id, query_no, kind, target,
         sites || ' ("' || seg || ' Analyst" OR ' || seg || ') '
           || array_to_string(case c_mktsegment {_sets} else {_words(fx.DEFAULT_SKILLS)} end, ' ')
           || case when extra <> '' then ' ' || extra else '' end || ' remote' as query
  from (select *, c_mktsegment[1] || lower(c_mktsegment[2:]) as seg from customer)
  cross join (values {_values}) t(query_no, kind, target, sites, extra)"""
ORACLE["search_plan"] = PLAN
ORACLE["search_plan_violations"] = f"""
  with w as (select profile_id, query_no, kind, target, profile_id + query_no as k from ({PLAN})),
  q as (select profile_id, kind, case when k % 29 = 0 then 'elsewhere.com' else target end as target, k % 23 = 0 as lacks
        from w, range(2) r(i) where i < case when k % 19 = 0 then 2 when k % 17 = 0 then 0 else 1 end),
  n as (select profile_id, kind, target, count(*) as n_queries, count(*) filter (lacks) as n_lacks from q group by all),
  j as (select coalesce(w.profile_id, n.profile_id) as profile_id, coalesce(w.kind, n.kind) as kind,
               coalesce(w.target, n.target) as target, coalesce(n_queries, 0) as n_queries, coalesce(n_lacks, 0) as n_lacks,
               w.profile_id is not null as wanted
        from w full outer join n on w.profile_id = n.profile_id and w.kind = n.kind and w.target = n.target)
  select profile_id, kind, target, n_queries, 'unknown_target' as rule from j where not wanted
  union all select profile_id, kind, target, n_queries, 'missing_query' from j where wanted and n_queries = 0
  union all select profile_id, kind, target, n_queries, 'repeated_query' from j where wanted and n_queries > 1
  union all select profile_id, kind, target, n_queries, 'word_missing' from j where n_lacks > 0"""

# -- health, views, streams ---------------------------------------------------------------------------

ORACLE["failure_streaks"] = f"""
  with a as (select 'h' || user_id as host, event_type = 'error' as failed, ts, event_id from events),
  {STREAKS}
  select * from streaks"""
ORACLE["stream_failure_streaks"] = ORACLE["failure_streaks"]
JOBS_STATUS = f"select j.*, coalesce(status, 'none') as status from ({CUSTOMER_JOBS}) j left join ({LATEST}) using (url)"
ORACLE["jobs_with_status"] = f"select c_custkey, url, status from ({JOBS_STATUS})"
ORACLE["dashboard_view"] = f"select c_custkey, score, salary, status from ({JOBS_STATUS}) where verdict = 'apply'"
ORACLE["above_threshold"] = f"select c_custkey, score from ({CUSTOMER_JOBS}) where coalesce(score, 0) >= 70"
ORACLE["top_jobs"] = f"""
  select c_custkey, title, score from ({CUSTOMER_JOBS}) order by coalesce(score, 0) desc, c_custkey limit 5"""
_COUNTERS = """
  d as (select doc_id, source, lang, n_chars, doc_id in (select doc_id from labels) as known,
               doc_id in (select doc_id from labels where quality = 1) as good,
               case when doc_id % 50 = 49 then 0 else n_chars % 101 end as score from documents),
  counters as (select count(*) as raw_total, count(*) filter (not known) as new_count, count(*) filter (good) as total,
                      count(*) filter (good and score >= 70) as above_threshold from d),
  best as (select *, row_number() over (order by score desc, doc_id) as n, 'https://' || source || '.example.com/d/' || doc_id as url,
                  case when doc_id % 5 = 0 then '(untitled)' else lang || ' role ' || doc_id end as title,
                  case when doc_id % 6 = 0 then '(unknown company)' else 'Co ' || lang end as company
           from d where good),
  top as (select * from best where n <= 5)"""
ORACLE["run_counters"] = f"with {_COUNTERS} select * from counters"
ORACLE["run_result"] = f"""
  with {_COUNTERS} select counters.*, (select string_agg(url || ' ' || score, '; ' order by n) from top) as top_jobs from counters"""
ORACLE["run_digest"] = f"""
  with {_COUNTERS}
  select 'Raw jobs scraped: ' || raw_total || chr(10) || 'New jobs: ' || new_count || chr(10) || 'Jobs scoring >= 70: '
           || above_threshold || chr(10) || chr(10) || 'Top ' || (select count(*) from top) || ' job(s):' || chr(10)
           || (select string_agg(n || '. ' || title || ' - ' || company || ' - score ' || score || ' - ' || url, chr(10) order by n) from top)
           as lines,
         new_count || ' new job(s), ' || above_threshold || ' scored >= 70. Top: '
           || (select title || ' @ ' || company || ' (' || score || ')' from top where n = 1) as body
  from counters"""
ORACLE["run_diff"] = f"""
  with s as (select dedup_key, run_id, max(line)::double as score from ({SIGHTINGS}) where run_id in {fx.DIFF_RUNS} group by all),
  a as (select * from s where run_id = {fx.DIFF_RUNS[0]}), b as (select * from s where run_id = {fx.DIFF_RUNS[1]})
  select coalesce(a.dedup_key, b.dedup_key) as dedup_key, a.score as old_score, b.score as new_score,
         case when a.score is null then 'added' when b.score is null then 'dropped' else 'rescored' end as change
  from a full outer join b on a.dedup_key = b.dedup_key where a.score is distinct from b.score"""
ORACLE["stream_ingest"] = " union all ".join(f"select source, url, salary from ({sql})" for sql in FEEDS)
ORACLE["stream_dedupe"] = "select distinct 'jobs.example.com/c/' || user_id || '?' as dedup_key from events"
ORACLE["stream_score_commit"] = f"""
  select 'jobs.example.com/t/' || md5 || '?' as dedup_key, doc_id,
         round(greatest(0.0, least(100.0, 60.0 * n_shared / {len(_skills)} + remote::int * 20 + 20 - n_flags * 10)), 4)::double as score
  from (
    select md5(text) as md5, doc_id, row_number() over (partition by md5(text) order by doc_id) as copy_no,
           len(list_intersect(words, {_words(_skills)})) as n_shared, list_has_any(words, {_words(fx.REMOTE_WORDS)}) as remote,
           len(list_intersect(words, {_words(fx.FLAG_WORDS)})) as n_flags
    from (select doc_id, text,
                 list_distinct(regexp_split_to_array(lower(lang || ' role ' || text), '[^\\pL\\pN+#]+')) as words from documents))
  where copy_no = 1"""
ORACLE["stream_day_counts"] = """
  select event_type as source, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all"""

ORACLE["sightings_per_day"] = """
  select event_type as source, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all"""
