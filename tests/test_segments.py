"""Segment logs, key tables and the bucketed state: few files, few reads, safe crashes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from postlane.operators.state import advance_state, latest_status, sighting_events
from postlane.schemas import STATE
from postlane.sources.buckets import BucketTable
from postlane.sources.keys import KeyTable, bucket_of, filters_of
from postlane.sources.segments import DATA, SealedLog, SegmentLog
from postlane.sources.tables import SCHEMAS, Store

DDL = {DATA: "n long"}


def numbers(spark, *values):
    return {DATA: spark.createDataFrame([(v,) for v in values], DDL[DATA])}


def held(log):
    return sorted(r["n"] for r in log.read().collect())


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_segments_merge_geometrically(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), DDL, fanout=3)
    assert log.segments() == [] and log.read().count() == 0 and log.next_entry() == 0
    for n in range(32):
        log.append([(n,)])
        assert len(log.segments()) <= 2 * 4
    assert log.segments() == [(0, 26), (27, 29), (30, 30), (31, 31)]
    assert held(log) == list(range(32)) and log.next_entry() == 32
    # What a merge hides goes with a later one: few files are left in all.
    assert len(files(tmp_path / "log")) <= 4 + 3 * 3


def test_a_merge_that_dies_changes_nothing(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), DDL, fanout=4)
    failing = SegmentLog(spark, str(tmp_path / "log"), DDL, fanout=4)
    failing.merge = lambda parts: {DATA: parts[DATA].withColumn("n", F.expr("raise_error('lost')").cast("long"))}
    for n in range(3):
        log.append([(n,)])
    with pytest.raises(Exception, match="lost"):
        failing.append([(3,)])
    assert held(log) == [0, 1, 2, 3] and len(log.segments()) == 4
    # The next level takes over what the lost merge has left behind.
    for n in range(4, 16):
        log.append([(n,)])
    assert log.segments() == [(0, 15)] and held(log) == list(range(16))


def test_a_replayed_entry_replaces_itself_or_is_hidden(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), DDL, fanout=2)
    log.write(0, numbers(spark, 1, 2))
    log.write(0, numbers(spark, 1, 2))
    log.write(1, numbers(spark, 3))
    log.write(2, numbers(spark, 4))
    log.write(1, numbers(spark, 3))
    assert held(log) == [1, 2, 3, 4] and log.segments() == [(0, 1), (2, 2)]
    # Entries may be missing: a merge takes what there is.
    log.write(5, numbers(spark, 5))
    log.write(7, numbers(spark, 7))
    assert held(log) == [1, 2, 3, 4, 5, 7] and log.segments() == [(0, 7)]


def keys_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "dedup_key string")


def test_known_keys_equal_sets(spark, tmp_path):
    rnd = random.Random(7)
    table = KeyTable(spark, str(tmp_path / "keys"), buckets=8, fanout=3)
    stored = {}
    assert table.known(keys_of(spark, ["a"]), 5).count() == 0
    for entry in range(7):
        batch = [f"k{rnd.randrange(400)}" for _ in range(60)]
        table.add(entry, keys_of(spark, batch))
        for k in batch:
            stored.setdefault(k, entry)
    asked = [f"k{n}" for n in range(500)] + ["k1", "", "é"]
    for before in (0, 1, 3, 4, 7):
        got = sorted(r[0] for r in table.known(keys_of(spark, asked), before).collect())
        assert got == sorted(k for k in set(asked) if stored.get(k, before) < before)


def test_filters_admit_all_stored_and_few_other_keys(spark):
    frame = lambda prefix, n: spark.range(n).select(
        F.concat(F.lit(prefix), "id").alias("dedup_key")).withColumn("bucket", bucket_of(F.col("dedup_key"), 4))
    table = KeyTable(spark, "/nowhere", 4)
    filters = filters_of(frame("k", 20_000)).cache()
    assert {r[0] for r in filters.select("slots").distinct().collect()} <= {2, 3}
    table.log.read = lambda part, segments: filters
    assert table.may_be_known(frame("k", 20_000), [(0, 0)]).count() == 20_000
    assert table.may_be_known(frame("x", 20_000), [(0, 0)]).count() < 20_000 * 0.01
    filters.unpersist()


def test_a_lookup_reads_touched_buckets_only(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "keys"), buckets=32)
    table.add(0, spark.range(2000).select(F.concat(F.lit("k"), "id").alias("dedup_key")))
    asked = keys_of(spark, ["k5", "k6", "new"])
    touched = {r[0] for r in asked.select(bucket_of(F.col("dedup_key"), 32)).collect()}
    # Whatever else is stored could not even be read.
    spoilt = 0
    for path in files(tmp_path / "keys" / "seg-000000000000-000000000000" / "data"):
        if int(path.split("bucket=")[1].split("/")[0]) not in touched:
            with open(path, "wb") as file:
                file.write(b"not a table")
            spoilt += 1
    assert spoilt >= 20
    known = table.known(asked, 1)
    assert sorted(r[0] for r in known.collect()) == ["k5", "k6"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


MARKS = "url string, status string, at string, mark_no long"


def test_many_marks_leave_few_files(spark, tmp_path):
    log = SealedLog(spark, str(tmp_path / "marks"), MARKS, seal_at=4)
    for n in range(40):
        log.append([(f"u{n % 7}", "applied", f"2024-01-01 00:00:{n:02d}", n)])
        if n % 9 == 0:
            assert {r["mark_no"] for r in log.read().collect()} == set(range(n + 1))
    # Loose files that wait for their deletion, and the segments of ten sealings and their remains.
    assert len(files(tmp_path / "marks" / "loose")) <= 2 * 4
    assert len(log.sealed.segments()) <= 8 + 1
    assert {r["mark_no"] for r in log.read().collect()} == set(range(40))


def test_sealing_that_dies_loses_no_mark(spark, tmp_path, monkeypatch):
    log = SealedLog(spark, str(tmp_path / "marks"), MARKS, seal_at=100)
    for n in range(6):
        log.append([(f"u{n}", "applied", "2024-01-01 00:00:00", n)])
    # Two writers seal the same loose files: a mark may be there twice, none is missing.
    log.sealed.write(0, {DATA: log.read().select("*", F.lit("elsewhere").alias("loose"))})
    log.seal()
    log.append([("u6", "skipped", "2024-01-01 00:00:00", 6)])
    log.seal()
    log.seal()
    assert {r["mark_no"] for r in log.read().collect()} == set(range(7))
    assert latest_status(log.read(), ["at", "mark_no"]).count() == 7


def state_rows(frame):
    return sorted(map(str, frame.collect()))


def sightings(spark, run_id, numbers):
    rows = [(i, "2024-01-01", f"Job {n}", "Co", "R", f"https://e.com/j/{n}", "d", "2024-01-01", "e.com", "", run_id) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, SCHEMAS["sightings"])


def events(spark, run_id, numbers):
    return sighting_events(sightings(spark, run_id, numbers))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "state"), STATE, "dedup_key", 64)
    first, second = events(spark, 1, range(1000)), events(spark, 2, [3, 4, 4000])
    assert table.as_of() is None and table.read().count() == 0
    assert table.change(first, 1, advance_state) == list(range(64))
    touched = table.touched(second)
    assert 1 <= len(touched) <= 3 and table.change(second, 2, advance_state) == touched
    written = {f.split("bucket=")[1].split("/")[0] for f in files(tmp_path / "state" / "data" / "version=1")}
    assert {int(b) for b in written} == set(touched)
    whole = advance_state(None, first.unionByName(second))
    assert state_rows(table.read()) == state_rows(whole) and table.as_of() == 2
    # A lookup reads the buckets of its keys.
    some = table.read(touched)
    assert len(some.inputFiles()) == len(touched)
    keys = {r["dedup_key"] for r in second.collect()}
    assert keys <= {r["dedup_key"] for r in some.collect()}
    # No events: the state is as it was, but as of a later run.
    assert table.change(second.limit(0), 5, advance_state) == [] and table.as_of() == 5
    assert state_rows(table.read()) == state_rows(whole)


def test_a_change_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "state"), STATE, "dedup_key", 8)
    table.change(events(spark, 1, range(50)), 1, advance_state)
    before = state_rows(table.read())
    dying = BucketTable(spark, str(tmp_path / "state"), STATE, "dedup_key", 8)
    dying._announce = lambda *args: (_ for _ in ()).throw(RuntimeError("driver is gone"))
    with pytest.raises(RuntimeError):
        dying.change(events(spark, 2, range(40, 60)), 2, advance_state)
    assert state_rows(table.read()) == before and table.as_of() == 1
    # The next try, with other events, is not mixed with what the first one left.
    table.change(events(spark, 2, [55]), 2, advance_state)
    assert state_rows(table.read()) == state_rows(advance_state(None, events(spark, 1, range(50)).unionByName(events(spark, 2, [55]))))


def test_versions_that_nobody_needs_are_deleted(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "state"), STATE, "dedup_key", 4)
    every = []
    for run_id in range(1, 7):
        every.append(events(spark, run_id, [run_id, run_id + 100]))
        table.change(every[-1], run_id, advance_state)
    assert len(files(tmp_path / "state" / "data")) <= 2 * 4
    assert len(files(tmp_path / "state" / "manifests")) == 2
    whole = every[0]
    for e in every[1:]:
        whole = whole.unionByName(e)
    assert state_rows(table.read()) == state_rows(advance_state(None, whole))


def test_a_stores_state_for_some_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), state_buckets=16)
    for run_id, numbers in ((1, range(60)), (2, range(50, 70))):
        store.replace("sightings", sightings(spark, run_id, numbers), ["run_id"])
        if run_id == 1:
            assert len(store.compact(1)) == 16
    whole = {r["dedup_key"]: r for r in store.state().collect()}
    assert len(whole) == 70
    asked = spark.createDataFrame([("e.com/j/5?",), ("e.com/j/65?",), ("nowhere.com/?",)], "dedup_key string")
    some = {r["dedup_key"]: r for r in store.state(asked).collect()}
    assert some.items() <= whole.items() and {"e.com/j/5?", "e.com/j/65?"} <= some.keys() and len(some) < 40
