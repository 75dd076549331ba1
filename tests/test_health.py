"""Failure streaks and attempt outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from postlane.operators import health


def sequential(attempts):
    """One attempt after the other; a host that reached the limit is never tried again."""
    streaks = {}
    for host, failed, day, _ in sorted(attempts, key=lambda a: a[3]):
        count, last = streaks.get(host, (0, None))
        if count >= 3:
            continue
        streaks[host] = (count + 1, day) if failed else (0, None)
    return {h: (n, d, n >= 3) for h, (n, d) in streaks.items() if n}


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 2), (3, 3), (4, 7), (5, 50), (6, 1000)])
def test_streaks_equal_sequential_walk(spark, seed, width):
    rnd = random.Random(seed)
    attempts = []
    for n in range(1500):
        host = "hot" if rnd.random() < 0.3 else f"h{rnd.randint(0, 120)}"
        failed = rnd.random() < (0.05 if host == "hot" else 0.45)
        attempts.append((host, failed, f"2024-01-{n // 60 + 1:02d}", n))
    frame = spark.createDataFrame(attempts, "host string, failed boolean, day string, n int").repartition(6)
    got = health.failure_streaks(frame, F.floor(F.col("n") / width), ["n"]).collect()
    assert {r.host: (r.consecutive_failures, r.last_failure, r.demoted) for r in got} == sequential(attempts)


def test_outcomes(spark):
    ddl = "host string, page string, try_no int, failed boolean, message string, code int, retry_after string"
    rows = [
        ("h", "ok", 0, False, None, None, None),
        ("h", "paid", 0, True, "HTTP 402", 402, None),
        ("h", "slow", 0, True, "HTTP 429", 429, "9"), ("h", "slow", 1, False, None, None, None),
        ("h", "slow2", 0, True, "rate limited 429", None, None), ("h", "slow2", 1, True, "HTTP 500", 500, None),
        ("h", "slow3", 0, True, "x", 429, "9999"), ("h", "slow3", 1, True, "x", 402, None),
        ("h", "odd", 0, True, "weird error", None, None),
    ]
    got = health.classify_attempts(spark.createDataFrame(rows, ddl))
    result = {(r.page, r.try_no): (r.http_status, r.outcome, r.wait_s) for r in got.collect()}
    assert result == {
        ("ok", 0): (None, "ok", None), ("paid", 0): (402, "abort", None),
        ("slow", 0): (429, "retry", 9.0), ("slow", 1): (None, "ok", None),
        ("slow2", 0): (429, "retry", 20.0), ("slow2", 1): (500, "fail", None),
        ("slow3", 0): (429, "retry", 60.0), ("slow3", 1): (402, "abort", None),
        ("odd", 0): (None, "fail", None)}
    assert sorted((r.page, r.try_no) for r in health.attempt_log(got).collect()) == [
        ("odd", 0), ("ok", 0), ("slow", 1), ("slow2", 1)]


def test_merged_summaries_fold_like_their_parts(spark):
    rnd = random.Random(9)
    rows, n = [], 0
    for host in range(150):
        rate = rnd.choice([0.3, 0.6, 0.9, 1.0])
        for _ in range(rnd.randrange(1, 25)):
            rows.append((f"h{host}", rnd.random() < rate, f"d{n:05d}", n))
            n += 1
    attempts = spark.createDataFrame(rows, "host string, failed boolean, day string, n int")
    parts = health.summarize_attempts(attempts, F.floor(F.col("n") / 3), ["n"]).cache()
    expected = sorted(map(tuple, health.fold_summaries(parts).collect()))
    whole = health.summarize_attempts(attempts, F.lit(0).cast("bigint"), ["n"])
    assert sorted(map(tuple, health.fold_summaries(whole).collect())) == expected
    # Any grouping of neighbours gives the same, and merging once more as well.
    for size in (2, 5, 1000):
        cut = F.floor(F.col("chunk") / size)
        merged = None
        for piece in [r[0] for r in parts.select(cut).distinct().collect()] if size == 1000 else range(0):
            merged = health.merge_summaries(parts.where(cut == piece))
        if merged is None:
            odd, even = (health.merge_summaries(parts.withColumn("host", F.concat_ws("|", "host", cut)).where(cut % 2 == k)) for k in (1, 0))
            merged = odd.unionByName(even).withColumn("host", F.split("host", "[|]")[0])
        assert sorted(map(tuple, health.fold_summaries(merged).collect())) == expected
        again = health.merge_summaries(merged)
        assert sorted(map(tuple, health.fold_summaries(again).collect())) == expected
    # One merged summary per host says what a summary of all its attempts says.
    plain = lambda df: sorted(str([r[c] for c in health.SUMMARY_COLUMNS if c != "chunk"]) for r in df.collect())
    assert plain(health.merge_summaries(parts)) == plain(whole)
