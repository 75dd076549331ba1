"""Search hits, interleaving, caps, extraction."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from postlane.operators import fetching, ordering
from postlane.sources import pages


def hits_frame(spark, lists):
    rows = [(q, json.dumps(hits)) for q, hits in enumerate(lists)]
    return pages.search_hits(spark.createDataFrame(rows, "query_no int, payload string"), 10)


def urls_of(*names):
    return [{"url": f"https://example.com/{n}", "title": n, "description": None} for n in names]


def test_hits_are_bounded_and_cleaned(spark):
    found = hits_frame(spark, [[{"url": None}, *urls_of(*[f"p{i}" for i in range(12)])]]).orderBy("hit_no").collect()
    assert [r.hit_no for r in found] == list(range(1, 10))
    assert found[0].title == "p0" and found[0].description == ""


def test_interleave_round_robin(spark):
    found = fetching.discovered_pages(hits_frame(spark, [urls_of("a0", "a1", "a2"), urls_of("b0", "b1"), []]))
    got = [r.title for r in found.orderBy("round_no", "query_no").collect()]
    assert got == ["a0", "b0", "a1", "b1", "a2"]


def test_regional_copies_keep_the_first_url(spark):
    lists = [[{"url": "https://www.indeed.com/viewjob?jk=1"}, {"url": "https://in.indeed.com/viewjob?jk=1"}],
             [{"url": "https://uk.indeed.com/viewjob?jk=1"}, {"url": "https://uk.indeed.com/viewjob?jk=2"}]]
    found = fetching.discovered_pages(hits_frame(spark, lists)).orderBy("round_no", "query_no").collect()
    assert [(r.round_no, r.url) for r in found] == [
        (1, "https://www.indeed.com/viewjob?jk=1"), (1, "https://uk.indeed.com/viewjob?jk=2")]


def numbered_pages(spark, hosts):
    rows = [(i, f"https://{h}/p/{i}") for i, h in enumerate(hosts)]
    return spark.createDataFrame(rows, "n int, url string").repartition(7)


def test_host_caps(spark):
    hosts = ["linkedin.com", "www.indeed.com", "uk.indeed.com", "indeed.com", "other.org"] * 12
    got = fetching.apply_host_caps(numbered_pages(spark, hosts), {"linkedin.com": 0, "indeed.com": 5, "x.com": 90},
                                   [F.col("n")], 20).orderBy("n").collect()
    expected, seen = [], defaultdict(int)
    caps = {"linkedin.com": 0, "indeed.com": 5}
    for i, h in enumerate(hosts):
        host = "indeed.com" if "indeed" in h else h
        if seen[host] < caps.get(host, 20):
            seen[host] += 1
            expected.append(i)
    assert [r.n for r in got] == expected


def test_fetch_plan_budget_and_actions(spark):
    hosts = ["reddit.com", "bad.org", "good.org"] + [f"h{i}.org" for i in range(40)]
    capped = fetching.apply_host_caps(numbered_pages(spark, hosts), {}, [F.col("n")], 20)
    assert fetching.apply_host_caps(numbered_pages(spark, hosts), {}, [F.col("n")], key=["n"]).count() == len(hosts)
    health = spark.createDataFrame([("bad.org", 3), ("good.org", 2)], "host string, consecutive_failures int")
    assert fetching.fetch_plan(capped, health, [F.col("n")]).count() == capped.count()
    plan = fetching.fetch_plan(capped, health, [F.col("n")], 20).orderBy("n").collect()
    assert [r.n for r in plan] == list(range(20))
    assert [r.action for r in plan[:4]] == ["snippet", "snippet", "scrape", "scrape"]
    assert [r.consecutive_failures for r in plan[:4]] == [0, 3, 2, 0]


def test_top_per_group_is_exact_for_a_hot_group(spark):
    rnd = random.Random(5)
    rows = [(("hot" if rnd.random() < 0.8 else f"g{rnd.randint(0, 9)}"), rnd.randint(0, 50), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, v int, id int").repartition(40)
    got = ordering.top_per_group(frame, ["g"], [F.col("v").desc(), F.col("id")], 7, "place", spread=5)
    expected = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:7]
        expected |= {(r[0], r[1], r[2], n) for n, r in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == expected


def test_global_position_and_next(spark):
    rnd = random.Random(9)
    ids = rnd.sample(range(10**9), 3000)
    frame = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").repartition(13)
    got = {r.id: r.idx for r in ordering.global_position(frame, ["id"], partitions=6).collect()}
    assert got == {v: n for n, v in enumerate(sorted(ids))}
    following = {r.id: r.nxt for r in ordering.next_in_order(frame, "id", "v", "nxt").collect()}
    order = sorted(ids)
    assert following == {a: f"v{b}" for a, b in zip(order, order[1:])} | {order[-1]: None}


def extracted(spark, payload):
    row = (1, "https://jobs.example.co.nz/listing", "Listing", "A listing page", payload)
    frame = spark.createDataFrame([row], "page_no int, url string, title string, description string, payload string")
    rows = pages.extracted_postings(frame).orderBy("pos").collect()
    return [(r.title, r.company, r.location, r.url, r.description, r.posted_date, r.source) for r in rows]


SNIPPET = [("Listing", "", "Remote", "https://jobs.example.co.nz/listing", "A listing page", "", "jobs.example.co.nz")]


def test_extraction_falls_back_to_the_snippet(spark):
    for payload in [None, "null", "[]", "oops", '{"jobs": []}', '{"jobs": null}', '{"jobs": "x"}', '{"jobs": [1, "a", {"title": " "}]}']:
        assert extracted(spark, payload) == SNIPPET, payload


def test_extraction_cleans_postings(spark):
    payload = json.dumps({"jobs": [
        {"title": " Real Job ", "url": "/j/1", "company": None, "location": "  "}, "noise", {"company": "untitled"},
        {"title": "Other", "url": "", "location": " Auckland ", "company": " Co ", "description": " d ", "posted_date": " today "},
        {"title": "Away", "url": "https://else.org/../x"}]})
    assert extracted(spark, payload) == [
        ("Real Job", "", "Remote", "https://jobs.example.co.nz/j/1", "", "", "jobs.example.co.nz"),
        ("Other", "Co", "Auckland", "https://jobs.example.co.nz/listing", "d", "today", "jobs.example.co.nz"),
        ("Away", "", "Remote", "https://else.org/../x", "", "", "jobs.example.co.nz")]


def test_anchor_postings(spark):
    html = '<p><a class="x" href="/j/1?a=1&amp;b=2">Dev &amp; <b>Ops</b></a><a href="k">\n</a><a href="https://o.org/z">Z</a>'
    frame = spark.createDataFrame([(1, "https://a.com/list/", html)], "page_id long, url string, html string")
    got = pages.anchor_postings(frame).orderBy("pos").collect()
    assert [(r.pos, r.title, r.url, r.source) for r in got] == [
        (0, "Dev & Ops", "https://a.com/j/1?a=1&b=2", "a.com"), (2, "Z", "https://o.org/z", "a.com")]
