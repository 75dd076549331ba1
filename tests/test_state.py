"""Set-based folds against sequential models, on random event sequences."""

import random

import pytest
from pyspark.sql import functions as F

from postlane.operators import state

EVENT_DDL = (
    "dedup_key string, run_id long, phase int, batch long, seq long, day string, url string, title string, "
    "company string, source string, location string, salary string, score double, verdict string, data string"
)
FIELDS = ["url", "title", "company", "source", "location", "salary", "score", "verdict", "data", "first_seen", "last_seen",
          "runs_seen", "first_seen_run", "last_seen_run", "last_scored_run"]


def random_events(seed, runs=5, keys=12):
    rnd = random.Random(seed)
    events = []
    for run in range(1, runs + 1):
        day, seq = f"2024-01-{run:02d}", 0
        for phase, n in ((state.SEEN, rnd.randint(0, 15)), (state.SCORED, rnd.randint(0, 8)), (state.OMITTED, rnd.randint(0, 8))):
            for _ in range(n):
                seq += 1
                key, tag = f"k{rnd.randint(1, keys)}?", f"{run}.{seq}"
                scored = phase == state.SCORED
                events.append((
                    key, run, phase, seq // 3, seq, day, f"https://{tag}/{key}", f"t{tag}", f"c{tag}", f"s{tag}", f"l{tag}",
                    rnd.choice(["", None, f"${seq}"]), float(seq) if scored else None, "apply" if scored else None,
                    f"d{tag}" if scored else None))
    return events


def sequential(events):
    """One event after the other, as a table that is updated in place."""
    rows = {}
    for e in sorted(events, key=lambda e: e[1:5]):
        key, run, phase, _, _, day, url, title, company, source, location, salary, score, verdict, data = e
        row = rows.get(key)
        if phase == state.OMITTED:
            if row:
                row.update(last_seen=day, last_seen_run=run, last_scored_run=run)
            continue
        new = dict(title=title, company=company, source=source, location=location, last_seen=day, last_seen_run=run)
        if row is None:
            row = rows[key] = dict.fromkeys(FIELDS)
            row.update(url=url, salary=salary, first_seen=day, first_seen_run=run, runs_seen=1)
        else:
            if salary:
                new["salary"] = salary
            row["runs_seen"] += phase == state.SEEN
        row.update(new)
        if phase == state.SCORED:
            row.update(score=score, verdict=verdict, data=data, last_scored_run=run)
    return rows


def as_dict(frame):
    return {r.dedup_key: {f: r[f] for f in FIELDS} for r in frame.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_sequential_updates(spark, seed):
    events = random_events(seed)
    frame = spark.createDataFrame(events, EVENT_DDL).repartition(5)
    assert as_dict(state.advance_state(None, frame)) == sequential(events)


@pytest.mark.parametrize("seed", range(4, 8))
def test_incremental_merge_equals_one_fold(spark, seed):
    events = random_events(seed)
    frame = spark.createDataFrame(events, EVENT_DDL)
    current = None
    for run in range(1, 6):
        current = state.advance_state(current, frame.where(F.col("run_id") == run))
        current = spark.createDataFrame(current.collect(), current.schema)
    assert as_dict(current) == sequential(events)
    whole = state.advance_state(None, frame)
    order = ["dedup_key", *state.FIRST_ORDER]
    assert sorted(map(tuple, current.select(*order).collect())) == sorted(map(tuple, whole.select(*order).collect()))


def sighting(url, run=1, seq=0, day="2024-01-01", title="Dev", salary=None):
    return (run, seq, day, url, title, "Co", "Remote", "example.com", salary)


def sightings(spark, *rows):
    ddl = "run_id long, seq long, day string, url string, title string, company string, location string, source string, salary string"
    return state.sighting_events(spark.createDataFrame(list(rows), ddl))


def test_repeat_in_one_run_counts_twice_and_blank_urls_are_skipped(spark):
    frame = sightings(spark, sighting("https://www.a.com/x"), sighting("https://uk.a.com/x", seq=1), sighting("", seq=2), sighting(None, seq=3))
    rows = state.advance_state(None, frame).collect()
    assert [(r.dedup_key, r.url, r.runs_seen) for r in rows] == [("a.com/x?", "https://www.a.com/x", 2)]


def test_blank_resighting_keeps_the_salary(spark):
    frame = sightings(spark, sighting("https://a.com/x", salary="$23.95-$28.00/hr"), sighting("https://a.com/x", run=2, day="2024-01-02"))
    row = state.advance_state(None, frame).first()
    assert (row.salary, row.runs_seen, row.first_seen, row.last_seen) == ("$23.95-$28.00/hr", 2, "2024-01-01", "2024-01-02")


def test_split_keeps_repeats_and_needs_an_attempt(spark):
    seen = state.advance_state(None, sightings(spark, sighting("https://a.com/x")))
    postings = spark.createDataFrame([("https://a.com/x", 1), ("https://www.a.com/x", 2), ("", 3)], "url string, n int")
    assert state.already_scored(postings, seen).count() == 0
    assert sorted(r.n for r in state.to_score(postings, seen).collect()) == [1, 2, 3]
    attempted = seen.withColumn("last_scored_run", F.lit(1).cast("long"))
    assert sorted(r.n for r in state.already_scored(postings, attempted).collect()) == [1, 2]
    assert [r.n for r in state.to_score(postings, attempted).collect()] == [3]


RUN_DDL = "run_id long, kind string, at string, status string, raw_total long, new_count long, above_threshold long"


def test_runs_are_closed_by_their_successor(spark):
    log = spark.createDataFrame(
        [(1, "start", "2024-01-01 08:00:00", None, None, None, None), (2, "start", "2024-01-02 08:00:00", None, None, None, None),
         (2, "finish", "2024-01-02 08:03:00", "ok", 5, 2, 1), (3, "start", "2024-01-03 08:00:00", None, None, None, None),
         (3, "finish", "2024-01-03 08:01:00", "failed", None, None, None), (4, "start", "2024-01-04 08:00:00", None, None, None, None)],
        RUN_DDL)
    expected = [
        (4, "2024-01-04 08:00:00", None, "running", None, None, None),
        (3, "2024-01-03 08:00:00", "2024-01-03 08:01:00", "failed", None, None, None),
        (2, "2024-01-02 08:00:00", "2024-01-02 08:03:00", "ok", 5, 2, 1),
        (1, "2024-01-01 08:00:00", "2024-01-02 08:00:00", "failed", None, None, None)]
    assert [tuple(r) for r in state.run_history(log).collect()] == expected
    assert sorted((tuple(r) for r in state.fold_runs(log).collect()), reverse=True) == expected
    assert [r.run_id for r in state.run_history(log, limit=2).collect()] == [4, 3]


def test_latest_status(spark):
    marks = spark.createDataFrame(
        [("u1", "applied", 1), ("u1", "skipped", 2), ("u2", "applied", 1), ("u2", "none", 2), ("u3", "applied", 1),
         ("u3", "hired", 2), ("u4", None, 1)], "url string, status string, n int")
    assert sorted(map(tuple, state.latest_status(marks, ["n"]).collect())) == [("u1", "skipped"), ("u3", "applied")]
    assert sorted(r.url for r in state.split_marks(marks)[1].collect()) == ["u3", "u4"]


def legacy(spark):
    seen = spark.createDataFrame(
        [("example.com/1?", "https://example.com/1", "Dev", "2024-01-01", "2024-01-05", 3, 0)],
        "dedup_key string, url string, title string, first_seen string, last_seen string, runs_seen long, seq long")
    ddl = "url string, title string, company string, source string, location string, salary string, score string, verdict string, data string, seq long"
    scored = spark.createDataFrame(
        [("https://example.com/1", "Dev", "A", "s", "l", "$1", "88", "apply", "{1}", 0),
         ("https://example.com/2", "New", "B", "s", "l", "$2", "x", "skip", "{2}", 1),
         ("https://www.example.com/2", "Newer", "C", "s", "l", "$3", "71", "apply", "{3}", 2),
         ("", "No link", "C", "s", "l", "$3", "71", "apply", "{4}", 3)], ddl)
    return seen, scored


def test_legacy_import(spark):
    empty = state.empty_state(spark.range(0))
    rows = {r.dedup_key: r for r in state.import_legacy(empty, *legacy(spark), "2026-09-06").collect()}
    assert set(rows) == {"example.com/1?", "example.com/2?"}
    one, two = rows["example.com/1?"], rows["example.com/2?"]
    assert (one.runs_seen, one.last_seen, one.score, one.data, one.company) == (3, "2024-01-05", 88.0, "{1}", None)
    assert (two.title, two.company, two.score, two.data, two.first_seen, two.runs_seen) == ("New", "B", 71.0, "{3}", "2026-09-06", 1)
    imported = state.import_legacy(empty, *legacy(spark), "2026-09-06")
    assert [r.data for r in state.scored_export(imported).collect()] == ["{1}", "{3}"]
    postings = spark.createDataFrame([("https://example.com/1",)], "url string")
    assert state.to_score(postings, imported).count() == 0
    assert state.import_legacy(imported, *legacy(spark), "2030-01-01") is imported
    # Later sightings keep the imported history.
    later = state.advance_state(imported, sightings(spark, sighting("https://example.com/1", run=9, day="2026-09-07")))
    row = later.where("dedup_key = 'example.com/1?'").first()
    assert (row.runs_seen, row.first_seen, row.last_seen, row.data) == (4, "2024-01-01", "2026-09-07", "{1}")


def test_exports(spark):
    events = random_events(42)
    frame = state.advance_state(None, spark.createDataFrame(events, EVENT_DDL))
    rows = sequential(events)
    first = {}
    for e in sorted(events, key=lambda e: e[1:5]):
        if e[2] != state.OMITTED:
            first.setdefault(e[0], len(first))
    scored = sorted((k for k in rows if rows[k]["data"]), key=first.get)
    assert [r.dedup_key for r in state.scored_export(frame).collect()] == scored
    assert [r.dedup_key for r in state.scored_export(frame, run_id=3).collect()] == [k for k in scored if rows[k]["last_scored_run"] == 3]
    seen = {r.dedup_key: (r.url, r.title, r.runs_seen) for r in state.seen_export(frame).collect()}
    assert seen == {k: (r["url"], r["title"] or "", r["runs_seen"]) for k, r in rows.items()}
