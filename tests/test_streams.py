"""Streams give the same results as the batch jobs, over several files and restarts."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from postlane.operators import health, scoring, state
from postlane.plans import catalog
from postlane.plans import fixtures as fx
from postlane.schemas import LANDED_FEED, POSTING_COLUMNS
from postlane.sources import feeds
from postlane.sources.tables import Store
from postlane.streaming import dedupe, ingest, runner
from postlane.streaming import health as stream_health
from postlane.streaming import scoring as stream_scoring

ATTEMPTS = "host string, failed boolean, day string, n int"


def land(spark, rows, schema, path, part):
    """Write one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(os.path.join(path, f"part={part:03d}"))


def stream(spark, schema, path, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(os.path.join(path, "part=*"))


def test_ingest_equals_batch(spark, tmp_path):
    landed = []
    for n in range(4):
        landed.append(("remotive.com", "", n, json.dumps({"jobs": [{"title": f"t{n}", "url": f"https://r.com/{n}", "salary": "$1"}]})))
        landed.append(("lever", "one", n, json.dumps([{"text": f"l{n}", "hostedUrl": f"https://l.co/{n}", "createdAt": "0"}])))
        landed.append(("adzuna", "", n, "not json"))
    frame = spark.createDataFrame(landed, LANDED_FEED)
    path = str(tmp_path / "landed")
    frame.repartition(5).write.partitionBy("source").json(path)
    for source in feeds.NORMALIZERS:
        os.makedirs(os.path.join(path, f"source={source}"), exist_ok=True)
    postings = ingest.posting_stream(spark, path, [*feeds.NORMALIZERS, "nope"])
    got = runner.drain_to_table(postings, str(tmp_path / "out"), str(tmp_path / "cp"))
    expected = feeds.NORMALIZERS["remotive.com"](frame).unionByName(feeds.NORMALIZERS["lever"](frame))
    assert sorted(map(tuple, got.select(*POSTING_COLUMNS).collect())) == sorted(map(tuple, expected.select(*POSTING_COLUMNS).collect()))


def small_tables(spark, folder):
    """Customers, parts and documents: nulls in what deals them, a repeated row, repeated keys."""
    customer = [(k, f"Customer {k}", "BUILDING", k % 25) for k in range(120)] + [(None, "nobody", None, None), (7, "again", "x", 3)]
    part = [(k, f"part {k}", f"Brand{k % 5}", "STEEL", k % 50, 900.0 + k) for k in range(120)] + [(None, None, None, None, None, None)]
    docs = [(k, f"word{k} <b>and</b> & more words\n" * 40, "en", f"src{k % 3}", 1000 + k) for k in range(300)]
    docs += [docs[5], (6, "another text", "fr", "src0", 12), (None, "no id", "de", "src1", 5), (9, None, None, None, None)]
    ddl = {
        "customer": "c_custkey long, c_name string, c_mktsegment string, c_nationkey int",
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
    }
    for (name, columns), rows in zip(ddl.items(), (customer, part, docs)):
        spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_landed_feeds_share_one_exchange_of_plain_rows(spark, tmp_path):
    landed = fx.landed_feeds(spark, small_tables(spark, tmp_path))
    rows = landed.collect()
    plan = landed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Three tables for seven feeds: no payload nor any part of one is shuffled.
    assert plan.count("ReusedExchange") == 4
    assert plan.count("REPARTITION_BY_COL") == 7 and "ENSURE_REQUIREMENTS" not in plan
    keys = [(r.source, r.board, r.fetch_no) for r in rows]
    assert len(set(keys)) == len(keys)
    lever = {(r.board, r.fetch_no): json.loads(r.payload) for r in rows if r.source == "lever"}
    assert set(lever) == {("src0", 0), ("src1", 0), ("src2", 0), ("src1", None), (None, 0)}
    titles = [x["text"] for x in lever["src2", 0]]
    assert titles[:4] == ["en role 2", "en role 5", "en role 5", "en role 8"] and len(titles) == 101
    assert [x["text"] for x in lever["src0", 0]][2:4] == ["en role 6", "fr role 6"]
    assert sum(len(json.loads(r.payload)["jobs"]) for r in rows if r.source == "remotive.com") == 122


def test_ingest_leaves_little_on_disk(spark, tmp_path):
    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    tables, held = small_tables(spark, tmp_path / "tables"), shuffle_files()
    mode = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = catalog.stream_ingest(spark, tables)
    expected = feeds.normalize_all(fx.landed_feeds(spark, tables), fx.search_config()["api_sources"])
    plain = expected.select("source", "url", F.coalesce("salary", F.lit("(none)")))
    out = os.path.dirname(got.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    until = time.time() + 30
    while (left := shuffle_files() - held) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == mode
    assert all(f.endswith(".zstd.parquet") for f in os.listdir(out) if f.startswith("part-"))
    landed = [f for _, _, names in os.walk(os.path.join(out, "../landed")) for f in names if f.startswith("part-")]
    assert landed and all(f.endswith(".json.gz") for f in landed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_dedupe_across_files_and_restarts(spark, tmp_path):
    path, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    rnd = random.Random(1)
    ddl = "id int, at string, dedup_key string"
    keys = []

    def drain():
        rows = stream(spark, ddl, path).withColumn("at", F.col("at").cast("timestamp"))
        return runner.drain_to_table(dedupe.dedupe_stream(rows, "at", "id", "10 days", spread=4), out, cp)

    for part in range(3):
        rows = [(part * 100 + i, f"2024-01-0{part + 1} 00:00:{i:02d}", "hot" if i % 3 else f"k{rnd.randint(0, 30)}") for i in range(60)]
        keys += [r[2] for r in rows]
        land(spark, rows, ddl, path, part)
        if part == 1:
            drain()
    assert sorted(r.dedup_key for r in drain().collect()) == sorted(set(keys))


def test_late_rows_are_dropped_from_day_counts(spark, tmp_path):
    path = str(tmp_path / "in")
    ddl = "source string, at string"
    land(spark, [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-02 10:00:00")], ddl, path, 0)
    land(spark, [("a", "2024-01-05 10:00:00")], ddl, path, 1)
    land(spark, [("a", "2024-01-05 11:00:00")], ddl, path, 2)
    # The watermark of the batch before decides what is late.
    land(spark, [("a", "2024-01-01 12:00:00"), ("b", "2024-01-05 12:00:00")], ddl, path, 3)
    land(spark, [("z", "2024-01-20 00:00:00")], ddl, path, 4)
    counts = ingest.sightings_per_day(stream(spark, ddl, path), F.col("at"))
    got = runner.drain_to_table(counts, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted(map(tuple, got)) == [
        ("a", "2024-01-01", 2), ("a", "2024-01-05", 2), ("b", "2024-01-02", 1), ("b", "2024-01-05", 1)]
    table = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 12:00:00")], ddl)
    assert [tuple(r) for r in ingest.sightings_per_day(table, F.col("at")).collect()] == [("a", "2024-01-01", 2)]


def test_streaks_equal_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rnd = random.Random(2)
    rows = [(f"h{rnd.randint(0, 25)}", rnd.random() < 0.5, f"2024-01-{n // 50 + 1:02d}", n) for n in range(400)]
    for part in range(8):
        land(spark, rows[part * 50 : part * 50 + 50], ATTEMPTS, path, part)
    summaries = str(tmp_path / "summaries")
    chunk = F.format_string("%06d", F.floor(F.col("n") / 20))
    write = stream_health.summary_writer(summaries, chunk, ["n"])
    runner.drain_batches(stream(spark, ATTEMPTS, path), write, str(tmp_path / "cp"))
    batch = health.failure_streaks(spark.createDataFrame(rows, ATTEMPTS), chunk, ["n"])
    expected = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, stream_health.current_streaks(spark, summaries).collect())) == expected
    # Replaying a micro-batch changes nothing.
    write(spark.createDataFrame(rows[350:], ATTEMPTS), 7)
    assert sorted(map(tuple, stream_health.current_streaks(spark, summaries).collect())) == expected


def test_streaks_of_many_micro_batches_stay_small(spark, tmp_path):
    rnd = random.Random(3)
    path, rows = str(tmp_path / "summaries"), []
    write = stream_health.summary_writer(path, F.format_string("%06d", F.floor(F.col("n") / 4)), ["n"], fanout=3)
    for batch in range(29):
        part = [(f"h{rnd.randint(0, 7)}", rnd.random() < 0.7, f"day {batch:02d}", batch * 20 + i) for i in range(20)]
        rows += part
        write(spark.createDataFrame(part, ATTEMPTS), batch)
    log = stream_health.summary_log(spark, path, 3)
    assert log.segments() == [(0, 26), (27, 27), (28, 28)]
    assert log.read().count() <= 8 + 2 * 20
    whole = health.failure_streaks(spark.createDataFrame(rows, ATTEMPTS), F.floor(F.col("n") / 4), ["n"])
    assert sorted(map(tuple, stream_health.current_streaks(spark, path).collect())) == sorted(map(tuple, whole.collect()))


def test_score_commits_skip_known_keys_and_can_be_replayed(spark, tmp_path):
    path = str(tmp_path / "in")
    ddl = "n int, " + ", ".join(f"{c} string" for c in POSTING_COLUMNS)

    def posting(n, url):
        return (n, f"Python {n}", "Co", "Remote", url, "spark", "2024-01-01", "s", "")

    files = [[posting(1, "https://a.com/1"), posting(2, "https://www.a.com/1"), posting(3, "https://a.com/2")],
             [posting(4, "https://a.com/2"), posting(5, "https://a.com/3")]]
    for part, rows in enumerate(files):
        land(spark, rows, ddl, path, part)

    def score(batch):
        scored = scoring.feature_score(batch, ["python", "spark"], F.lit("2024-01-02").cast("date"), ["remote"], [])
        return scored.select(
            "dedup_key", F.lit(state.SCORED).alias("phase"), F.lit(0).cast("long").alias("batch"), F.col("n").cast("long").alias("seq"),
            "url", "title", "company", "source", "location", "salary", "score", "verdict", F.lit("{}").alias("data"), F.lit("2024-01-02").alias("day"))

    store = Store(spark, str(tmp_path / "store"))
    write = stream_scoring.commit_writer(store, score, ["n"])
    runner.drain_batches(stream(spark, ddl, path), write, str(tmp_path / "cp"))

    def stored():
        return sorted((r.run_id, r.dedup_key, r.seq, r.score) for r in store.read("scores").collect())

    expected = [(0, "a.com/1?", 1, 80.0), (0, "a.com/2?", 3, 80.0), (1, "a.com/3?", 5, 80.0)]
    assert stored() == expected
    write(spark.createDataFrame(files[1], ddl), 1)
    write(spark.createDataFrame(files[0], ddl), 0)
    assert stored() == expected
    assert state.to_score(spark.createDataFrame([posting(9, "https://a.com/3")], ddl), store.state()).count() == 0
