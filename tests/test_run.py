"""Whole runs over stored tables: crash, resume, compaction, exports."""

import json

import pytest
from pyspark.sql import functions as F

from postlane.operators import state
from postlane.plans import run, views
from postlane.schemas import POSTING_COLUMNS
from postlane.sources.tables import Store


def postings(spark, numbers, salary=""):
    rows = [(i, f"Job {n}", "Co", "Remote", f"https://www.example.com/j/{n}", "d", "2024-01-01", "example.com", salary)
            for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} string" for c in POSTING_COLUMNS))


def make_scorer(fail_on=None):
    """Scores even jobs and leaves odd ones out; nested, so that workers get it by value."""

    def scorer(payload, today, profile):
        if fail_on and fail_on in payload:
            raise RuntimeError("model is down")
        jobs = json.loads(payload)
        return json.dumps([{"title": j["title"], "url": j["url"], "score": 70 + int(j["title"][4:]) % 30, "verdict": "apply"}
                           for j in jobs if int(j["title"][4:]) % 2 == 0])

    return scorer


good_scorer, failing_scorer = make_scorer(), make_scorer('"Job 25"')


def history(store):
    return [(r.run_id, r.status, r.raw_total, r.new_count, r.above_threshold) for r in state.run_history(store.read("run_events")).collect()]


def test_crash_and_resume(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="model is down"):
        run.execute_run(store, 1, postings(spark, range(30)), failing_scorer, "2024-01-01 08:00:00", "2024-01-01 08:05:00",
                        batches_per_commit=1)
    # Two batches were stored; the third never returned.
    assert history(store) == [(1, "failed", None, None, None)]
    assert {r.commit_no for r in store.read("scores").collect()} == {0, 1}
    assert store.state().count() == 30

    todo = state.to_score(store.sightings(1), store.state())
    assert sorted(r.title for r in todo.collect()) == sorted(f"Job {n}" for n in range(20, 30))

    result = run.execute_run(store, 2, postings(spark, range(32)), good_scorer, "2024-01-02 08:00:00", "2024-01-02 08:05:00",
                             batches_per_commit=1).first()
    assert (result.raw_total, result.new_count, result.total, result.above_threshold) == (32, 12, 6, 6)
    assert [j.title for j in result.top_jobs] == ["Job 28", "Job 26", "Job 24", "Job 22", "Job 20"]
    assert history(store) == [(2, "ok", 32, 12, 6), (1, "failed", None, None, None)]

    final = {r.title: r for r in store.state().collect()}
    assert len(final) == 32 and final["Job 3"].runs_seen == 2 and final["Job 31"].runs_seen == 1
    assert final["Job 2"].last_scored_run == 1 and final["Job 22"].last_scored_run == 2
    assert final["Job 3"].data is None and final["Job 3"].last_scored_run == 1

    # A third run finds nothing to score, and says so.
    again = run.execute_run(store, 3, postings(spark, range(32)), failing_scorer, "2024-01-03 08:00:00", "2024-01-03 08:05:00").first()
    assert (again.new_count, again.total, list(again.top_jobs)) == (0, 0, [])


def test_commits_and_compaction_are_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    args = (good_scorer, "2024-01-01 08:00:00", "2024-01-01 08:05:00")
    run.execute_run(store, 1, postings(spark, range(25), "$5"), *args)
    before = sorted(map(str, store.state().collect()))
    run.commit_scores(store, 1, 0, good_scorer, "2024-01-01", "")
    assert sorted(map(str, store.state().collect())) == before

    store.compact(1)
    assert store.newest_snapshot() == 1
    assert sorted(map(str, store.state().collect())) == before
    run.execute_run(store, 2, postings(spark, range(20, 40)), good_scorer, "2024-01-02 08:00:00", "2024-01-02 08:05:00")
    whole = sorted(map(str, state.advance_state(None, store.events()).collect()))
    assert sorted(map(str, store.state().collect())) == whole
    store.compact(2)
    assert sorted(map(str, store.state().collect())) == whole
    # Only the runs after the snapshot are scanned.
    assert store.events(2).count() == 0

    queries = spark.createDataFrame([(0, "site:a.com dev remote"), (1, "site:b.com dev remote")], "query_no int, query string")
    assert run.record_search_plan(store, 2, queries).count() == 2
    with pytest.raises(RuntimeError, match="no search queries"):
        run.record_search_plan(store, 3, queries.limit(0))
    run.write_exports(store, 2)
    assert spark.read.json(str(tmp_path / "runs" / "run_id=2" / "search_config")).count() == 2
    exported = [r.title for r in spark.read.json(str(tmp_path / "exports" / "jobs")).collect()]
    assert sorted(exported) == sorted(f"Job {n}" for n in range(0, 40, 2))
    assert spark.read.json(str(tmp_path / "exports" / "seen")).count() == 40
    assert spark.read.json(str(tmp_path / "runs" / "run_id=2" / "raw_jobs")).count() == 20
    assert spark.read.json(str(tmp_path / "runs" / "run_id=2" / "jobs")).count() == 7


def test_answers_without_results_leave_their_batch_open(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    prose = lambda payload, today, profile: '{"jobs": []}' if '"Job 3"' in payload else "Sorry, I cannot do that."
    with pytest.raises(RuntimeError, match="2 batches have no readable answer"):
        run.execute_run(store, 1, postings(spark, range(20)), prose, "2024-01-01 08:00:00", "2024-01-01 08:05:00")
    assert history(store) == [(1, "failed", None, None, None)]
    assert state.to_score(store.sightings(1), store.state()).count() == 20
    run.execute_run(store, 2, postings(spark, range(20)), good_scorer, "2024-01-02 08:00:00", "2024-01-02 08:05:00")
    assert state.to_score(store.sightings(1), store.state()).count() == 0


def test_a_restarted_run_keeps_and_reuses_what_was_paid_for(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    calls = tmp_path / "calls"
    calls.mkdir()
    times = ("2024-01-01 08:00:00", "2024-01-01 08:05:00")

    def counting(inner):
        def scorer(payload, today, profile):
            first = json.loads(payload)[0]["title"]
            (calls / f"{first}-{len(list(calls.iterdir()))}-{id(payload)}").touch()
            return inner(payload, today, profile)

        return scorer

    with pytest.raises(RuntimeError, match="model is down"):
        run.execute_run(store, 1, postings(spark, range(30)), counting(failing_scorer), *times, batches_per_commit=1)
    before = {r.title: r.score for r in store.state().collect() if r.data}
    assert len(before) == 10 and len(list(calls.iterdir())) == 3
    # The same id again, even with other postings: the first plan stands.
    result = run.execute_run(store, 1, postings(spark, range(5)), counting(good_scorer), *times, batches_per_commit=7).first()
    after = {r.title: r.score for r in store.state().collect() if r.data}
    assert before.items() <= after.items() and len(after) == 15
    assert (result.raw_total, result.new_count) == (30, 30)
    assert len(list(calls.iterdir())) == 4
    with pytest.raises(ValueError, match="finished"):
        run.execute_run(store, 1, postings(spark, range(30)), good_scorer, *times)


def test_legacy_exports_become_the_first_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    seen = spark.createDataFrame([("www.example.com/j/1?", "https://www.example.com/j/1", "Job 1", "2023-01-01", "2023-02-01", 4, 0)],
                                 "dedup_key string, url string, title string, first_seen string, last_seen string, runs_seen long, seq long")
    scored = spark.createDataFrame([("https://www.example.com/j/2", "Job 2", "Co", "s", "l", None, "80", "apply", "{}", 0)],
                                   "url string, title string, company string, source string, location string, salary string, "
                                   "score string, verdict string, data string, seq long")
    assert store.import_legacy(seen, scored, "2024-01-01")
    assert {(r.title, r.score) for r in store.state().collect()} == {("Job 1", None), ("Job 2", 80.0)}
    assert not store.import_legacy(seen, scored, "2024-01-01")
    run.execute_run(store, 1, postings(spark, range(3, 5)), good_scorer, "2024-01-01 08:00:00", "2024-01-01 08:05:00")
    assert store.state().count() == 4


def test_replacing_a_run_leaves_other_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_sightings(1, "2024-01-01", postings(spark, [1, 2]))
    store.write_sightings(2, "2024-01-02", postings(spark, [3]))
    store.write_sightings(2, "2024-01-02", postings(spark, [4]))
    assert sorted((r.run_id, r.title) for r in store.read("sightings").collect()) == [(1, "Job 1"), (1, "Job 2"), (2, "Job 4")]
    assert store.read("answers").count() == 0


def jobs(spark):
    rows = [("u1", "Ärzte", "$60,000-$80,000", 70.0, "apply", "Zürich", 0), ("u2", "beta", "$23.95-$28.00/hr", 90.0, "skip", "auckland", 1),
            ("u3", "Alpha", "", None, "apply", "Berlin", 2), ("u4", "alpha", "$90k", 70.0, "maybe", None, 3)]
    return spark.createDataFrame(rows, "url string, company string, salary string, score double, verdict string, location string, ord int")


def order(frame):
    return [r.url for r in frame.collect()]


def test_dashboard_orders_and_filters(spark):
    shown = lambda **k: order(views.dashboard_view(jobs(spark), tie_break=("ord",), **k))
    assert shown() == ["u2", "u1", "u4", "u3"]
    assert shown(sort="score-asc") == ["u3", "u1", "u4", "u2"]
    assert shown(sort="salary-desc") == ["u1", "u4", "u2", "u3"]
    assert shown(sort="company-asc") == ["u4", "u3", "u1", "u2"]
    assert shown(sort="location-asc") == ["u4", "u2", "u3", "u1"]
    assert shown(verdict="apply") == ["u1", "u3"]


def test_status_joins_on_the_exact_url(spark):
    marks = spark.createDataFrame([("u1", "applied"), ("U2", "skipped")], "url string, status string")
    got = {r.url: r.status for r in views.jobs_with_status(jobs(spark), marks).collect()}
    assert got == {"u1": "applied", "u2": "none", "u3": "none", "u4": "none"}


def test_top_jobs_are_stable(spark):
    assert order(views.top_jobs(jobs(spark), k=3)) == ["u2", "u1", "u4"]
    assert order(views.above_threshold(jobs(spark)).orderBy("ord")) == ["u1", "u2", "u4"]


def test_digest(spark):
    scored = jobs(spark).withColumn("title", F.when(F.col("ord") != 1, F.concat(F.lit("Job "), "ord"))).withColumn(
        "company", F.when(F.col("ord") != 3, F.col("company")))
    result = views.run_result(jobs(spark), jobs(spark).limit(3), scored)
    row = views.digest(result).first()
    assert row.lines.split("\n") == [
        "Raw jobs scraped: 4", "New jobs: 3", "Jobs scoring >= 70: 3", "", "Top 4 job(s):",
        "1. (untitled) - beta - score 90 - u2", "2. Job 0 - Ärzte - score 70 - u1",
        "3. Job 3 - (unknown company) - score 70 - u4", "4. Job 2 - Alpha - score 0 - u3"]
    assert row.body == "3 new job(s), 3 scored >= 70. Top: (untitled) @ beta (90)"
    nothing = views.digest(views.run_result(jobs(spark), jobs(spark).limit(0), scored.limit(0))).first()
    assert nothing.lines.endswith("\n\nNo new jobs scored this run.") and nothing.body == "0 new job(s), 0 scored >= 70"


def test_run_diff(spark):
    ddl = "dedup_key string, score double"
    old = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", None)], ddl)
    new = spark.createDataFrame([("b", None), ("c", 4.0), ("d", 5.0), ("e", None)], ddl)
    got = {r.dedup_key: r.change for r in views.run_diff(old, new).collect()}
    assert got == {"a": "dropped", "c": "rescored", "d": "rescored", "e": "added"}


def test_a_run_from_hits_and_feeds(spark, tmp_path):
    from postlane.settings import source_config
    from postlane.sources import feeds, pages

    store = Store(spark, str(tmp_path / "store"))
    config = source_config({"api_sources": ["remotive.com", "nope"], "scrape_caps": {"capped.org": 0}})
    hits = [[{"url": f"https://{h}.org/list", "title": f"At {h}", "description": "s"} for h in ("good", "broken", "capped", "flaky")]]
    landed_hits = spark.createDataFrame([(0, json.dumps(hits[0]))], "query_no int, payload string")
    attempts = [("broken.org", True, "2024-01-01", n) for n in range(3)] + [("flaky.org", True, "2024-01-01", 3), ("flaky.org", False, "2024-01-01", 4)]
    store.write_attempts(0, spark.createDataFrame(attempts, "host string, failed boolean, day string, n long"))
    assert [tuple(r) for r in store.host_health().collect()] == [("broken.org", 3, "2024-01-01", True)]

    plan = run.plan_fetches(store, pages.search_hits(landed_hits), config).orderBy("round_no", "query_no")
    assert [(r.host, r.action) for r in plan.collect()] == [("good.org", "scrape"), ("broken.org", "snippet"), ("flaky.org", "scrape")]

    extract = json.dumps({"jobs": [{"title": "Job 2", "url": "/2"}, {"title": "Job 4", "url": "/2"}]})
    fetched = plan.select(
        F.col("round_no").alias("page_no"), "url", "title", "description",
        F.when(F.col("action") == "scrape", F.lit(extract)).alias("payload"))
    folder = tmp_path / "landed" / "source=remotive.com" / "board=__HIVE_DEFAULT_PARTITION__"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"jobs": [{"title": "Job 8", "url": "https://good.org/2", "salary": "$1"}]}))
    (folder / "b.json").write_text("not json")
    landed = feeds.read_payload_files(spark, str(tmp_path / "landed"))
    gathered = run.gather_postings(pages.extracted_postings(fetched), landed, config)
    rows = [(r.seq, r.title, r.url, r.salary) for r in gathered.orderBy("seq").collect()]
    assert rows == [(0, "Job 2", "https://good.org/2", None), (1, "At broken", "https://broken.org/list", None),
                    (2, "Job 2", "https://flaky.org/2", None), (3, "Job 8", "https://good.org/2", "$1")]


def test_a_run_without_postings_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(RuntimeError, match="no postings"):
        run.execute_run(store, 1, postings(spark, [1]).limit(0), good_scorer, "2024-01-01 08:00:00", "2024-01-01 08:00:01")
    assert history(store) == [(1, "failed", None, None, None)]


def test_status_marks(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.mark_status("u1", "applied", "2024-01-01 08:00:00")
    store.mark_status("u2", "skipped", "2024-01-01 08:00:00")
    store.mark_status("u2", "none", "2024-01-01 08:00:01")
    with pytest.raises(ValueError, match="applied, skipped, none"):
        store.mark_status("u3", "hired", "2024-01-01 08:00:00")
    assert [tuple(r) for r in store.statuses().collect()] == [("u1", "applied")]
