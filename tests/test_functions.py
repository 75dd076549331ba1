"""Column functions against literal vectors and the Python standard library."""

import html
import json
import random
import time
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from postlane.functions import fields, model_json, pay, text, urls


def apply(spark, fn, rows, n=1):
    """Results of ``fn(c0, .., cn-1)`` over string rows, in order."""
    names = [f"c{i}" for i in range(n)]
    data = [(i, *(r if n > 1 else (r,))) for i, r in enumerate(rows)]
    schema = "i int, " + ", ".join(f"{c} string" for c in names)
    frame = spark.createDataFrame(data, schema).select("i", fn(*[F.col(c) for c in names]).alias("out"))
    return [r.out for r in sorted(frame.collect(), key=lambda r: r.i)]


def test_canonical_host(spark):
    pairs = {
        "www.indeed.com": "indeed.com",
        "ng.indeed.com": "indeed.com",
        "ph.jobstreet.com": "jobstreet.com",
        "onlinejobs.ph": "onlinejobs.ph",
        "glassdoor.co.uk": "glassdoor.co.uk",
        "WWW.In.Indeed.com": "indeed.com",
        "in.uk.x.com": "uk.x.com",
        "go.co.nz": "co.nz",
        "": "",
        "www.": "",
        "12.34.56": "34.56",
        "user@www.x.com:80": "user@www.x.com:80",
    }
    assert apply(spark, urls.canonical_host, list(pairs)) == list(pairs.values())


def python_key(url):
    p = urlparse(url)
    host = p.netloc.lower().removeprefix("www.")
    labels = host.split(".")
    if len(labels) > 2 and len(labels[0]) == 2:
        host = host.partition(".")[2]
    return host + p.path + "?" + p.query


def random_urls(n, seed):
    rnd = random.Random(seed)
    parts = ["http://", "https://", "//", "www.", "uk.", "a.b", "x.com", "/", "/p", ";v=1", "?q=1",
             "#f", "..", ".", "a b", ":80", "é", "%20", "?", "#", ";", "//", "&k=?", "HTTP:", "mailto:"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(n)]


def test_dedup_key_matches_standard_library(spark):
    cases = random_urls(3000, 7)
    cases += ["", "https://uk.indeed.com/viewjob?jk=1#x", "  https://www.a.com/b", "https://a.com/x\n/y"]
    assert apply(spark, urls.dedup_key, cases) == [python_key(c) for c in cases]
    assert apply(spark, urls.dedup_key, [None]) == ["?"]


def test_dedup_key_of_long_url(spark):
    url = "https://x.com/" + "a;b/" * 20000 + "?" + "q" * 50000 + "#" + "f\n" * 50000
    assert apply(spark, urls.dedup_key, [url]) == [python_key(url)]


def test_resolve_url_matches_standard_library(spark):
    rnd = random.Random(11)
    bases = ["https://a.com", "https://a.com/", "http://a.com/x/y", "https://a.com/x/y/", "https://a.com/x/y?q=1#f",
             "https://a.com/x/;p/y;z?k", "http://h//d//e"]
    bits = ["..", ".", "/", "a", "b.html", "?k=v", "#top", ";p", "//h.org", "https:", "http:", "x/y"]
    pairs = [(rnd.choice(bases), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7)))) for _ in range(3000)]
    pairs += [("https://a.com/l", "/j/1"), ("https://a.com/l", "j/1"), ("https://a.com/l", ""),
              ("https://a.com/l", "https://b.com/z"), ("https://a.com/l", "mailto:x@y")]
    got = apply(spark, urls.resolve_url, pairs, 2)
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert wrong == []


def test_strip_html_and_whitespace(spark):
    cases = ["<p>a</p>\n<br>b  c", "", None, "  x<y>z ", "a < b > c", "\x1c\x85t　"]

    def python_strip(t):
        import re
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t or "")).strip()

    assert apply(spark, text.strip_html, cases) == [python_strip(c) for c in cases]
    padded = ["  a b ", "\x1d\n", "x", ""]
    assert apply(spark, text.strip, padded) == [c.strip() for c in padded]


def test_html_unescape(spark):
    cases = ["&lt;p&gt;Build &amp; launch&lt;/p&gt;", "&amp;lt;", "&amp;amp;lt;", "&copy;&middot;&nbsp;&#39;",
             "&eacute;&hearts;", "&#233; &#xe9; &#x1F600;", "AT&T &notanentity; &", "&copyright &ampx", "plain", "",
             "&quot;&apos;", "&#38;lt;"]
    assert apply(spark, text.html_unescape, cases) == [html.unescape(c) for c in cases]
    assert apply(spark, text.html_to_text, ["&lt;p&gt;Build &amp;amp; launch rockets&lt;/p&gt;"]) == [
        "Build & launch rockets"]


@pytest.mark.parametrize("fn,rows,expected", [
    (pay.salary_range_text, [("60000", "80000"), ("60000", "60000"), ("0", "80000"), ("60000", None), (None, None),
                             ("x", "1"), ("-5", "7"), ("0.5", None), ("12d", "3"), ("55000.0", "65000.0")],
     ["$60,000-$80,000", "$60,000", "$80,000", "$60,000", "", "", "$7", "$0", "", "$55,000-$65,000"]),
    (fields.place_text, [("Auckland CBD", "Auckland City"), ("Dunedin", "dunedin"), ("", ""), (None, "X"), ("A", None)],
     ["Auckland CBD, Auckland City", "dunedin", "New Zealand", "X", "A"]),
    (fields.http_status, [("HTTP 429 now", None), ("weird", None), ("x", "500"), ("error 4290", None), ("got 404.", None), ("HTTP 404", "abc")],
     [429, None, 500, None, 404, None]),
])
def test_pairs(spark, fn, rows, expected):
    assert apply(spark, fn, rows, 2) == expected


def test_pay_text(spark):
    rows = [("23.95", "28.00", "hourly"), ("24.00", "24.00", "hourly"), ("28.00", None, "hourly"),
            ("60000", "80000", "annually"), ("0.00", "0.00", "hourly"), (None, None, "voluntary"),
            ("4000", None, " Monthly "), ("1234.5", "2000", "daily"), ("abc", "1", "hourly")]
    assert apply(spark, pay.pay_text, rows, 3) == [
        "$23.95-$28.00/hr", "$24.00/hr", "$28.00/hr", "$60,000-$80,000/yr", "", "", "$4,000/mo",
        "$1,234.50-$2,000.00", ""]


def test_money_rounds_like_python(spark):
    rnd = random.Random(3)
    values = [repr(round(rnd.uniform(0, 99999), rnd.randint(0, 4))) for _ in range(500)] + ["0.5", "1.5", "2.5", "2.675"]
    assert apply(spark, lambda c: pay.salary_range_text(c, F.lit(None).cast("string")), values) == [
        f"${float(v):,.0f}" if float(v) > 0 else "" for v in values]
    assert apply(spark, lambda c: pay.pay_text(c, F.lit(None).cast("string"), F.lit("hourly")), values) == [
        f"${float(v):,.2f}/hr" if float(v) > 0 else "" for v in values]


def test_salary_value(spark):
    assert apply(spark, pay.salary_value, ["$23.95-$28.00/hr", "$60,000-$80,000", "", None, "none", "1.2.3", "$5."]) == [
        28.0, 80000.0, 0.0, 0.0, 0.0, 1.2, 5.0]


def test_dates_scores_and_waits(spark):
    assert apply(spark, fields.epoch_ms_to_date, ["1786319437378", "0", "-1", "soon", None, "", "99999999999999999"]) == [
        "2026-08-09", "1970-01-01", "1969-12-31", "soon", "", "", "99999999999999999"]
    assert apply(spark, fields.score_cast, ["85", " 72.5 ", "high", None, "12d", "1e2"]) == [85.0, 72.5, None, None, None, 100.0]
    assert apply(spark, fields.retry_after, ["9", "9999", "-3", None, "soon"]) == [9.0, 60.0, 0.0, 20.0, 20.0]
    assert apply(spark, lambda c: fields.score_band(fields.score_cast(c)), ["80", "79.9", "60", "59", None]) == [
        "high", "mid", "mid", "low", "low"]
    assert apply(spark, fields.verdict_class, ["apply", "skip", "maybe", None]) == ["apply", "skip", "other", "other"]
    fresh = apply(spark, lambda c: fields.is_fresh(c.try_cast("date"), F.lit("2024-03-01").cast("date")),
                  ["2024-01-31", "2024-01-30", "bad", None, "2024-03-05"])
    assert fresh == [True, False, False, False, True]


def test_model_json(spark):
    cases = {
        '[{"score": 88}]': '[{"score": 88}]',
        '```json\n{"target_roles": ["VA"]}\n```': '{"target_roles": ["VA"]}',
        'Here [not json] it is:\n\n[{"title": "Rep", "score": 72}]\n\nBye {x}': '[{"title": "Rep", "score": 72}]',
        '{"a": 1}\ndata: [DONE]\n\n': '{"a": 1}',
        "Sorry, I cannot do that.": None,
        "": None,
        "{broken": None,
        '[{"b": 2, "a": 1.50}] and [3]': '[{"b": 2, "a": 1.5}]',
        '[{"a": 1}, {"b"': '{"a": 1}',
        "[{'a': 1}] or [2]": "[2]",
    }
    got = apply(spark, model_json.model_json, list(cases))
    loads = lambda s: None if s is None else json.loads(s)
    assert [loads(g) for g in got] == [loads(c) for c in cases.values()]


def test_json_buried_in_prose_is_found_where_a_parser_finds_it(spark):
    rnd = random.Random(12)
    bits = ["[", "]", "{", "}", '"', ":", ",", "1", "-2.5e3", "true", "NaN", "x y", " ", "\n", '"a"', '{"a": 1}', "[2]", "\\", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(400)]
    # Every bracket's rest, tried one after the other.
    rest = F.transform(F.sequence(F.lit(1), F.length("t")), lambda at: F.col("t").substr(at, F.lit(1000)))
    good = F.filter(rest, lambda s: s.rlike(r"^[\[{]") & F.try_parse_json(s).isNotNull())
    df = spark.createDataFrame([(f"so: {t}",) for t in texts], "t string")
    rows = df.select("t", model_json.model_json(F.col("t")).alias("got"), F.get_json_object(F.try_element_at(good, F.lit(1)), "$").alias("e"))
    for r in rows.collect():
        assert r["got"] == r["e"], r["t"]


def test_long_prose_with_many_brackets(spark):
    prose = "see [note] and {that} \\ " * 25_000
    cases = {prose + '[{"a": 1}] bye': '[{"a":1}]', prose: None, "[" * 50_000: None, prose + '{"a": [1, ' * 300: None}
    start = time.process_time()
    for text, value in cases.items():
        found = model_json.first_value(text)
        assert (None if found is None else found.replace(" ", "")) == value
    assert time.process_time() - start < 20
    assert apply(spark, model_json.model_json, list(cases)) == list(cases.values())
