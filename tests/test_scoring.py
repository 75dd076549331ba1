"""Batches, matching, contract checks, feature scores."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from postlane.functions.model_json import model_json
from postlane.operators import scoring, searchplan
from postlane.schemas import SCORED
from postlane.settings import source_config

INPUT_DDL = "run_id long, batch long, pos int, url string, title string, company string, source string, location string, salary string"


def python_key(url):
    return url.split("//", 1)[1].replace("www.", "") + "?"


def sequential_match(inputs, results):
    """Tiers of one batch, tried result by result."""
    by_url, by_title = {}, {}
    for i in inputs:
        if i["url"]:
            by_url.setdefault(python_key(i["url"]), i)
        if i["title"].strip():
            by_title.setdefault(i["title"].strip().lower(), i)
    out = []
    for n, r in enumerate(results):
        url, title = r.get("url") or "", (r.get("title") or "").strip().lower()
        hit, tier = (by_url.get(python_key(url)) if url else None), "url"
        if hit is None:
            hit, tier = by_title.get(title), "title"
        if hit is None:
            hit, tier = (inputs[n], "position") if n < len(inputs) else (None, "unmatched")
        final = (hit or {}).get("url") or url
        if final:
            out.append((n, tier, python_key(final), r.get("title") or (hit or {}).get("title", "")))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_sequential_model(spark, seed):
    rnd = random.Random(seed)
    input_rows, result_rows, expected, left_out = [], [], set(), set()
    for batch in range(30):
        inputs = [{"url": rnd.choice(["", f"https://a.com/{rnd.randint(0, 9)}"]), "title": rnd.choice(["", " Dev ", "dev", "QA", f"T{i}"])}
                  for i in range(rnd.randint(1, 10))]
        results = [{"url": rnd.choice([None, "", f"https://www.a.com/{rnd.randint(0, 12)}"]), "title": rnd.choice([None, "DEV", "qa", "T1", "Nobody"]),
                    "score": rnd.choice(["88", 70, None, "high"])} for _ in range(rnd.randint(0, 12))]
        input_rows += [(1, batch, i, x["url"], x["title"], "c", "s", "l", "$1") for i, x in enumerate(inputs)]
        result_rows.append((1, batch, json.dumps(results)))
        matched = sequential_match(inputs, results)
        expected |= {(batch, *m) for m in matched}
        keys = {m[2] for m in matched}
        left_out |= {(batch, i) for i, x in enumerate(inputs) if x["url"] and python_key(x["url"]) not in keys}
    inputs = spark.createDataFrame(input_rows, INPUT_DDL).repartition(4)
    answers = spark.createDataFrame(result_rows, "run_id long, batch long, raw string")
    got = scoring.match_results(scoring.parse_answers(answers), inputs)
    assert {(r.batch, r.result_no, r.tier, r.dedup_key, r.title) for r in got.collect()} == expected
    omitted = scoring.omitted_inputs(inputs, got, scoring.readable_answers(answers))
    assert {(r.batch, r.pos) for r in omitted.collect()} == left_out


def test_batches_of_ten(spark):
    frame = spark.createDataFrame([(i * 7,) for i in range(25)], "seq long").repartition(9)
    rows = scoring.assign_batches(frame, ["seq"]).orderBy("seq").collect()
    assert [(r.idx, r.batch, r.pos) for r in rows] == [(i, i // 10, i % 10) for i in range(25)]


def test_payload_and_scorer_calls(spark, tmp_path):
    ddl = "run_id long, batch long, pos int, title string, company string, location string, url string, description string, posted_date string, source string, salary string"
    rows = [(1, b, p, f"t{b}{p}", "c", "l", f"u{b}{p}", 'say "hi"\n', "d", "s", None) for b, n in ((0, 10), (1, 3)) for p in reversed(range(n))]
    payloads = scoring.batch_payloads(spark.createDataFrame(rows, ddl).repartition(3))
    got = {r.batch: json.loads(r.payload) for r in payloads.collect()}
    assert [p["title"] for p in got[0]] == [f"t0{i}" for i in range(10)] and len(got[1]) == 3
    assert got[0][0]["description"] == 'say "hi"\n' and "salary" not in got[0][0]

    def scorer(payload, today, profile):
        return f"{today} {profile} " + json.dumps([{"title": str(len(json.loads(payload))), "score": 1}])

    answers = scoring.call_scorer(payloads, scorer, "2024-02-01", "me")
    parsed = scoring.parse_answers(answers).collect()
    assert sorted((r.batch, r.r.title) for r in parsed) == [(0, "10"), (1, "3")]


def test_unreadable_answers_are_set_aside(spark):
    rows = [(1, 0, "[]"), (1, 1, "no"), (1, 2, None), (1, 3, '{"jobs": [{"title": "a"}]}'), (1, 4, 'ok: [{"title": "T1"}]')]
    answers = spark.createDataFrame(rows, "run_id long, batch long, raw string")
    assert sorted(r.batch for r in scoring.unreadable_answers(answers).collect()) == [1, 2, 3]
    assert [(r.batch, r.r.title) for r in scoring.parse_answers(answers).collect()] == [(4, "T1")]
    inputs = spark.createDataFrame([(1, b, 0, f"https://a.com/{b}", "t", "c", "s", "l", "") for b in range(6)], INPUT_DDL)
    matched = scoring.match_results(scoring.parse_answers(answers), inputs)
    omitted = scoring.omitted_inputs(inputs, matched, scoring.readable_answers(answers))
    assert [r.batch for r in omitted.collect()] == [0]
    assert sorted(r.batch for r in scoring.batches_to_retry(inputs, answers).collect()) == [1, 2, 3, 5]


def test_calls_are_spread_and_errors_are_rows(spark):
    import os

    def scorer(payload, today, profile):
        if payload == "p7":
            raise ValueError("too long")
        return str(os.getpid())

    payloads = spark.range(200).selectExpr("1L as run_id", "id as batch", "concat('p', id) as payload").coalesce(1)
    answers = scoring.call_scorer(payloads, scorer, "", "", concurrency=16)
    tasks = answers.select("batch", "raw", "error", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 200 and len({r.task for r in tasks}) == 16
    assert [(r.batch, r.raw, r.error) for r in tasks if r.error] == [(7, None, "ValueError: too long")]


def test_payloads_reach_python_in_small_pieces(spark):
    size = scoring.PIECE_CHARS
    texts = {0: "", 1: None, 2: "short", 3: "é😀\n" * size, 4: "x" * size, 5: "y" * (5 * size + 1)}
    payloads = spark.createDataFrame([(1, b, t) for b, t in texts.items()], "run_id long, batch long, payload string").coalesce(1)
    longest = scoring.in_pieces(payloads).agg(F.max(F.length("piece"))).first()[0]
    assert longest == size
    answers = scoring.call_scorer(payloads, lambda p, today, profile: repr(p), "", "", concurrency=1)
    assert {r.batch: r.raw for r in answers.collect()} == {b: repr(t) for b, t in texts.items()}
    # The frames that Python gets hold no whole payload.
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Generate posexplode" in plan


def test_pieces_and_workers_stay_few(spark):
    """Ten thousand rows make a batch for Python; a task reads its answers once."""
    assert 10_000 * scoring.PIECE_CHARS <= 1 << 21
    answers = spark.createDataFrame(
        [(1, 0, 'so: [{"url": "u"}]'), (1, 1, "none"), (1, 2, None)], "run_id long, batch long, raw string"
    )
    results = scoring.parse_answers(answers)
    assert [(r.batch, r.result_no, r.r.url) for r in results.collect()] == [(0, 0, "u")]
    assert results._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


class Refused(Exception):
    def __init__(self, code):
        super().__init__(f"HTTP {code}")
        self.code = code


def flaky(errors, calls):
    """Raises the given errors, one per call, before it answers."""

    def call():
        calls.append(time.monotonic())
        if len(calls) <= len(errors):
            raise errors[len(calls) - 1]
        return "[]"

    return call


@pytest.mark.parametrize("errors, answer, n_calls", [
    ([Refused(429), ConnectionResetError("gone")], ("[]", None), 3),
    ([Refused(503)] * 3, (None, "Refused: HTTP 503 (after 3 attempts)"), 3),
    ([Refused(401)], (None, "Refused: HTTP 401"), 1),
    ([TimeoutError("slow"), ValueError("bad prompt")], (None, "ValueError: bad prompt"), 2),
    ([], ("[]", None), 1),
])
def test_errors_are_retried_by_their_kind(errors, answer, n_calls):
    calls = []
    policy = scoring.CallPolicy(time_limit_s=5, backoff_s=0.05)
    assert scoring.answered(flaky(errors, calls), policy) == answer
    assert len(calls) == n_calls and all(b - a >= 0.05 for a, b in zip(calls, calls[1:]))


def test_a_call_that_hangs_is_given_up():
    calls = []

    def call():
        calls.append(1)
        time.sleep(0.01 if len(calls) == 3 else 30)
        return "late but there"

    start = time.monotonic()
    assert scoring.answered(call, scoring.CallPolicy(time_limit_s=0.3, backoff_s=0)) == ("late but there", None)
    assert scoring.answered(lambda: time.sleep(30), scoring.CallPolicy(time_limit_s=0.1, attempts=2, backoff_s=0)) == (
        None, "TimeoutError: no answer within 0.1 s (after 2 attempts)")
    assert time.monotonic() - start < 10


def test_calls_in_flight_are_bounded_and_answers_keep_their_order():
    lock, now, most = threading.Lock(), [0], [0]

    def run(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (n % 3))
        with lock:
            now[0] -= 1
        return n

    taken = []
    calls = (taken.append(n) or n for n in range(30))
    out = []
    for n in scoring.in_order(calls, run, 4):
        out.append(n)
        # The input is not read ahead of the open calls.
        assert len(taken) - len(out) < 4
    assert out == list(range(30)) and 2 <= most[0] <= 4


def test_quoted_and_bad_scores(spark):
    raw = json.dumps([{"title": "a", "score": "85"}, {"title": "b", "score": 72.5}, {"title": "c", "score": "great"}, 3, {"title": "d"}])
    rows = scoring.parse_answers(spark.createDataFrame([(1, 0, raw)], "run_id long, batch long, raw string"))
    got = rows.select("r.title", scoring.fields.score_cast(F.col("r.score")).alias("s")).collect()
    assert [(r.title, r.s) for r in got if r.title] == [("a", 85.0), ("b", 72.5), ("c", None), ("d", None)]


def test_contract(spark):
    ddl = "n int, score string, verdict string, salary string, input_salary string, input_description string"
    rows = [(1, "88", "apply", "", "", ""), (2, "101", "apply", "$5", "$5 - $9", ""), (3, "60", "maybe", "$7", "", "pays $8"),
            (4, None, None, "$7", None, "pays $7 per hour")]
    got = scoring.contract_violations(spark.createDataFrame(rows, ddl)).collect()
    assert sorted((r.n, r.rule) for r in got) == [
        (2, "score_range"), (3, "below_threshold"), (3, "salary_not_in_input"), (3, "verdict"), (4, "score_range"), (4, "verdict")]


POSTS = [
    (1, "Remote Python Dev", "python and spark, c++", "2024-01-20"),
    (2, "Python Dev", "Python PYTHON java", "2023-01-01"),
    (3, "Clerk", "relocation required; python", "2024-01-31"),
    (4, "Gardener", "plants", "2024-01-31"),
]


def posts(spark):
    return spark.createDataFrame(POSTS, "id int, title string, description string, posted_date string")


def test_feature_score(spark):
    got = scoring.feature_score(posts(spark), ["python", "spark", "c++"], F.lit("2024-02-01").cast("date"), ["remote"], ["relocation"])
    rows = {r.id: (r.score, r.verdict, list(r.match_reasons), list(r.red_flags)) for r in got.collect()}
    assert rows == {
        1: (100.0, "apply", ["c++", "python", "spark"], []),
        2: (20.0, "skip", ["python"], []),
        3: (30.0, "skip", ["python"], ["relocation"]),
        4: (20.0, "skip", [], [])}


def test_profile_matches_equal_brute_force(spark):
    people = [(1, ["Python", "Spark"]), (2, ["spark", "python"]), (3, ["java"]), (4, ["cobol"]), (5, ["python", "python", "plants"])]
    profiles = spark.createDataFrame(people, "profile_id int, skills array<string>")
    today = F.lit("2024-02-01").cast("date")
    got = scoring.profile_top_matches(profiles, posts(spark), "id", today, ["remote"], ["relocation"], k=2)
    expected = set()
    for person, skills in people:
        wanted = sorted({s.lower() for s in skills})
        scored = scoring.feature_score(posts(spark), wanted, today, ["remote"], ["relocation"]).collect()
        best = sorted((r for r in scored if r.match_reasons), key=lambda r: (-r.score, r.id))[:2]
        expected |= {(person, r.id, len(r.match_reasons), r.score, n) for n, r in enumerate(best, 1)}
    assert {(r.profile_id, r.id, r.n_shared, r.score, r.place) for r in got.collect()} == expected


def test_a_word_in_all_postings_pairs_few_groups(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    sets = [["hot", *sorted(rnd.sample(words, rnd.randrange(0, 5)))] for _ in range(120)]
    sets = [sorted(s) for s in {tuple(s) for s in sets}]
    rows = [(i, ["hot", *rnd.sample(words, rnd.randrange(0, 4))], rnd.choice([0, 10, 20, 40])) for i in range(1500)]
    frame = spark.createDataFrame(
        [(i, s) for i, s in enumerate(sets)], "set_id long, skill_set array<string>")
    groups = {}
    for i, signature, base in rows:
        groups.setdefault((tuple(sorted(signature)), base), []).append(i)
    listed = spark.createDataFrame(
        [(list(s), b, ids[:3]) for (s, b), ids in groups.items()], "signature array<string>, base_points int, ids array<int>")
    pairs = [(r["set_id"], tuple(r["signature"]), r["base_points"], r["n_shared"]) for r in scoring.candidate_pairs(frame, listed, "id", 3).collect()]
    assert len(pairs) == len({p[:3] for p in pairs})
    # All sets share a word with all groups; far fewer pairs are looked at.
    assert len(pairs) < len(sets) * len(groups) / 5
    score = lambda shared, wanted, base: round(max(0.0, min(100.0, 60.0 * shared / wanted + base)), 4)
    looked_at = {p[:3] for p in pairs}
    for n, skills in enumerate(sets):
        every = sorted((-score(len(set(s) & set(skills)), len(skills), b), i, s, b) for (s, b), ids in groups.items() for i in ids)
        assert all((n, s, b) in looked_at for _, _, s, b in every[:3])


def test_search_plan_and_its_rules(spark):
    people = spark.createDataFrame([(1, ["Virtual Assistant", "VA"], ["calendar management", "Excel"])],
                                   "profile_id int, roles array<string>, skills array<string>")
    config = source_config({"job_boards": ["wellfound.com"]})
    plan = searchplan.search_plan(people, config)
    rows = [(r.kind, r.target, r.query) for r in plan.orderBy("query_no").collect()]
    assert rows[0] == ("board", "wellfound.com", 'site:wellfound.com ("Virtual Assistant" OR VA) "calendar management" Excel remote')
    assert len(rows) == 4 and "site:reddit.com/r/jobbit OR" in rows[1][2] and rows[3][2].endswith("hiring remote")
    assert searchplan.plan_violations(plan, people, config).count() == 0
    kept = plan.where("target <> 'Community'").select("profile_id", "kind", "target", "query")
    bad = kept.union(kept.where("kind = 'board'")).union(spark.createDataFrame([(1, "board", "x.com", "site:x.com")], kept.schema))
    got = {(r.target, r.rule) for r in searchplan.plan_violations(bad, people, config).collect()}
    assert got == {("Community", "missing_query"), ("wellfound.com", "repeated_query"), ("x.com", "unknown_target"), ("x.com", "word_missing")}


def test_plan_rules_keep_repeats_and_nulls_apart(spark):
    config = {"job_boards": ["a.com"], "reddit_groups": []}
    people = spark.createDataFrame([(1,), (1,), (2,), (None,)], "profile_id long")
    rows = [(2, "a.com"), (2, "a.com"), (None, "a.com"), (3, None)]
    plans = spark.createDataFrame([(i, "board", t, "q remote") for i, t in rows], "profile_id long, kind string, target string, query string")
    got = sorted(map(str, searchplan.plan_violations(plans, people, config).collect()))
    row = "Row(profile_id={}, kind='board', target={}, n_queries={}, rule='{}')".format
    assert got == sorted([
        row(1, "'a.com'", 0, "missing_query"), row(1, "'a.com'", 0, "missing_query"), row(2, "'a.com'", 2, "repeated_query"),
        row(None, "'a.com'", 0, "missing_query"), row(None, "'a.com'", 1, "unknown_target"), row(3, None, 1, "unknown_target"),
    ])


def test_plan_marks_are_dealt_to_tasks_before_they_are_counted(spark, monkeypatch):
    """No map task counts marks, and tasks grow in number with the profiles."""
    monkeypatch.setattr(searchplan, "MARKS_PER_TASK", 100)
    config = {"job_boards": ["a.com", "b.com"], "reddit_groups": []}
    people = spark.range(1000).withColumnRenamed("id", "profile_id")
    plans = searchplan.expand_targets(people, config).select("profile_id", "kind", "target", F.lit("remote").alias("query"))
    broken = searchplan.plan_violations(plans, people, config)
    assert broken.count() == 0
    plan = broken._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and ", 41)" in exchanges[0] and "SortMergeJoin" not in plan


def test_search_plan_answer_is_read_with_its_schema(spark):
    from postlane.schemas import SEARCH_PLAN
    raw = '```json\n{"target_roles": ["VA"], "key_skills": [], "search_queries": ["a remote"]}\n```'
    row = spark.createDataFrame([(raw,)], "raw string").select(F.from_json(model_json(F.col("raw")), SEARCH_PLAN).alias("p")).first()
    assert (row.p.target_roles, row.p.search_queries) == (["VA"], ["a remote"])
    assert "suggested_angle" in SCORED.names
