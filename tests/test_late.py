"""Streams that set late and repeated rows aside: no row is lost, replays change nothing."""

import collections
import random
from datetime import timedelta

from pyspark.sql import functions as F

from postlane.functions import urls
from postlane.streaming import late, runner
from tests.test_streams import land, stream

ROWS = "source string, ts timestamp, n int"
TEXT_ROWS = "source string, ts string, n int"


def out_of_order(rnd, files):
    """Files whose days mostly rise, with rows from long before among them."""
    for part in range(files):
        rows = []
        for i in range(25):
            day = max(1, part + 1 - (rnd.randrange(2, 6) if rnd.random() < 0.2 else 0))
            at = None if rnd.random() < 0.03 else f"2024-03-{day:02d} {rnd.randrange(24):02d}:00:00"
            rows.append((rnd.choice("ab"), at, part * 100 + i))
        yield rows


def test_rows_in_are_rows_out_and_rows_aside(spark, tmp_path):
    path, everything = str(tmp_path / "in"), []
    for part, rows in enumerate(out_of_order(random.Random(5), 11)):
        land(spark, rows, TEXT_ROWS, path, part)
        everything.append(rows)
    days = late.DayCounts(spark, str(tmp_path / "days"), ROWS, timedelta(days=1), fanout=3)
    timed = stream(spark, TEXT_ROWS, path).withColumn("ts", F.col("ts").cast("timestamp"))
    runner.drain_batches(timed, days.write, str(tmp_path / "cp"))

    # One file after the other, as the stream has read them.
    counts, aside, high = collections.Counter(), set(), ""
    for rows in everything:
        limit = f"2024-03-{int(high[8:10]) - 1:02d} {high[11:]}" if high else ""
        for source, at, n in rows:
            if at is None or (high and f"2024-03-{int(at[8:10]) + 1:02d} 00:00:00" <= limit):
                aside.add(n)
            else:
                counts[source, at[:10]] += 1
        high = max([high, *[at for _, at, _ in rows if at]])
    got = {(r["source"], r["day"]): r["n"] for r in days.counts().collect()}
    assert got == counts and {r["n"] for r in days.late().collect()} == aside and len(aside) > 10
    total = sum(map(len, everything))
    assert days.rows_seen() == total == sum(got.values()) + days.late().count()
    # With the late ones the counts are those of a batch job.
    plain = collections.Counter((s, at[:10]) for rows in everything for s, at, _ in rows if at)
    assert {(r["source"], r["day"]): r["n"] for r in days.counts(with_late=True).collect()} == plain
    closed = {(r["source"], r["day"]) for r in days.closed_days().collect()}
    assert closed and all(day < "2024-03-11" for _, day in closed) and closed < set(got)
    assert len(days.log.segments()) <= 5
    # Replays, of a merged micro-batch and of the last one.
    frame = lambda rows: spark.createDataFrame(rows, TEXT_ROWS).withColumn("ts", F.col("ts").cast("timestamp"))
    for n in (2, 10):
        days.write(frame(everything[n]), n)
    assert {(r["source"], r["day"]): r["n"] for r in days.counts().collect()} == counts
    assert days.rows_seen() == total and days.late().count() == len(aside)


def test_keys_are_kept_once_over_a_streams_whole_life(spark, tmp_path):
    rnd = random.Random(6)
    ddl = "n int, url string, title string"
    kept = late.KeptOnce(spark, str(tmp_path / "kept"), ddl, ["n"], fanout=3)
    files = [[(part * 100 + i, f"https://www.e.com/{rnd.randrange(40)}", "t") for i in range(20)] for part in range(5)]
    for part, rows in enumerate(files):
        kept.write(spark.createDataFrame(rows, ddl), part)
    seen, expected, aside = set(), set(), {}
    for rows in files:
        before = set(seen)
        for n, url, _ in rows:
            if url in seen:
                aside[n] = "stored" if url in before else "repeat"
            else:
                expected.add(n)
            seen.add(url)
    check = lambda: (
        {r["n"] for r in kept.kept().collect()} == expected
        and {r["n"]: r["reason"] for r in kept.side().collect()} == aside
        and kept.kept().count() + kept.side().count() == 100
    )
    assert check()
    kept.write(spark.createDataFrame(files[4], ddl), 4)
    kept.write(spark.createDataFrame(files[1], ddl), 1)
    assert check()
    key = spark.range(1).select(urls.dedup_key(F.lit("https://www.e.com/1"))).first()[0]
    assert {r["dedup_key"] for r in kept.kept().where("url like '%/1'").collect()} <= {key}
