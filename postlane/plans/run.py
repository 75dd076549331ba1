"""A whole run over stored tables: record, split, score in committed steps, report."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane import settings
from postlane.operators import fetching, ordering, scoring, state
from postlane.plans import views
from postlane.schemas import POSTING_COLUMNS
from postlane.sources import feeds
from postlane.sources.tables import Store, export_json, export_objects


def record_search_plan(store: Store, run_id: int, queries: DataFrame) -> DataFrame:
    """Store a run's search queries ``(query_no, query)``; a run without any fails."""
    stamped = queries.select(F.col("query_no").cast("long").alias("query_no"), "query").withColumn(
        "run_id", F.lit(run_id).cast("long")
    )
    if stamped.isEmpty():
        raise RuntimeError("no search queries: check the answer that should hold them")
    store.replace("search_plans", stamped, ["run_id"])
    return store.read("search_plans").where(F.col("run_id") == run_id)


def plan_fetches(store: Store, hits: DataFrame, config: dict) -> DataFrame:
    """The pages a run fetches, from its search hits, the host caps and the hosts' health."""
    order = [F.col("round_no"), F.col("query_no")]
    budget = config.get("page_budget")
    found = fetching.discovered_pages(hits)
    capped = fetching.apply_host_caps(found, config.get("scrape_caps", {}), order, budget)
    return fetching.fetch_plan(capped, store.host_health(), order, budget)


def gather_postings(extracted: DataFrame, landed: DataFrame, config: dict) -> DataFrame:
    """A run's postings in order (``seq``): pages first, then the configured feeds.

    Postings of pages are deduplicated by key over all pages, the first one winning;
    feed postings are added as they are, repeats included.
    """
    keyed = state.with_key(extracted.where(F.length("url") > 0))
    scraped = ordering.dedupe_first(keyed, "dedup_key", ["page_no", "pos"]).select(
        F.lit(0).alias("_list"), F.col("page_no").cast("long").alias("_a"), F.col("pos").cast("long").alias("_b"), *POSTING_COLUMNS
    )
    from_feeds = feeds.merge_feeds(
        landed, config.get("api_sources", []), config.get("ats_boards"), config.get("max_postings_per_source")
    ).select(
        F.lit(1).alias("_list"), F.col("list_no").cast("long").alias("_a"), F.col("slot").cast("long").alias("_b"), *POSTING_COLUMNS
    )
    together = ordering.global_position(scraped.unionByName(from_feeds), ["_list", "_a", "_b"], "seq")
    return together.drop("_list", "_a", "_b")


# The commit number under which a run's plan is announced.
PLAN = -1


# A run has so many commits at most, unless it is told how large they are.
COMMITS = 1000
BATCHES_PER_COMMIT = 200


def finished_commits(store: Store, run_id: int) -> DataFrame:
    """``commit_no`` of a run's commits with no open batch left, its plan included."""
    log = store.read("commits").where((F.col("run_id") == run_id) & (F.col("open_batches") == 0))
    return log.select("commit_no").distinct()


def is_planned(store: Store, run_id: int) -> bool:
    return not finished_commits(store, run_id).where(F.col("commit_no") == PLAN).isEmpty()


def open_commits(store: Store, run_id: int) -> list[int]:
    """Numbers of the commits that still have to run; as many as commits at most."""
    planned = store.read("inputs").where(F.col("run_id") == run_id).select("commit_no").distinct()
    left = planned.join(finished_commits(store, run_id), "commit_no", "left_anti")
    return sorted(r["commit_no"] for r in left.collect())


def plan_inputs(store: Store, run_id: int, batches_per_commit: int | None = None) -> DataFrame:
    """Batch a run's unscored postings and store them; returns them as stored.

    The size of a commit grows with the run by default, so that a run of any size has a
    bounded number of them.

    A restarted run keeps the batches of its first attempt, so that answers and scores
    stored under their numbers stay where they belong.
    """
    if not is_planned(store, run_id):
        seen = state.with_key(store.sightings(run_id))
        inputs = state.to_score(seen, store.state(seen))
        batched = scoring.assign_batches(inputs, ["seq"])
        if batches_per_commit is None:
            batches = -(-inputs.count() // settings.SCORE_BATCH_SIZE)
            batches_per_commit = max(BATCHES_PER_COMMIT, -(-batches // COMMITS))
        batched = batched.withColumn("commit_no", F.floor(F.col("batch") / batches_per_commit).cast("long"))
        columns = store.read("inputs").columns
        store.replace_run("inputs", batched.select(*columns), run_id, ["commit_no"])
        store.append("commits", [(run_id, PLAN, 0)])
    return store.read("inputs").where(F.col("run_id") == run_id)


def commit_scores(
    store: Store, run_id: int, commit_no: int, scorer, day: str, profile: str, concurrency: int | None = None
) -> tuple[int, str | None]:
    """Score one group of batches: keep the raw answers first, then their events.

    Only batches without a readable answer are sent to the scorer; each try is stored
    beside the earlier ones. Returns the number of batches still open and an error.
    """
    here = (F.col("run_id") == run_id) & (F.col("commit_no") == commit_no)
    inputs = store.read("inputs").where(here)
    before = store.read("answers").where(here)
    missing = scoring.batches_to_retry(inputs, before)
    tries = before.agg(F.max("attempt_no")).first()[0]
    tries = 0 if tries is None else tries + 1
    payloads = scoring.batch_payloads(inputs.join(missing, ["run_id", "batch"], "left_semi"))
    answers = scoring.call_scorer(payloads, scorer, day, profile, concurrency)
    stamped = answers.withColumn("commit_no", F.lit(commit_no).cast("long")).withColumn("attempt_no", F.lit(tries).cast("long"))
    store.replace("answers", stamped, ["run_id", "commit_no", "attempt_no"])

    # From here on the stored answers are read, never the scorer again.
    stored = store.read("answers").where(here)
    readable = scoring.readable_answers(stored)
    matched = scoring.match_results(scoring.parse_answers(stored), inputs)
    omitted = scoring.omitted_inputs(inputs, matched, readable)
    events = scoring.score_events(matched, omitted, F.lit(day))
    store.replace(
        "scores", events.withColumn("commit_no", F.lit(commit_no).cast("long")), ["run_id", "commit_no"]
    )
    still_open = scoring.batches_to_retry(inputs, stored)
    failed = stored.join(still_open, ["run_id", "batch"]).agg(F.max("error")).first()[0]
    return still_open.count(), failed


def score_all(
    store: Store, run_id: int, scorer, day: str, profile: str, parallel_commits: int, concurrency: int | None
) -> None:
    """Score a run's commits, several at a time; raises if batches stay open."""
    todo = open_commits(store, run_id)
    score = lambda n: commit_scores(store, run_id, n, scorer, day, profile, concurrency)
    left, error = 0, None
    with ThreadPoolExecutor(parallel_commits) as pool:
        # The log is written here, one commit after the other, as they finish.
        for commit_no, (open_batches, failed) in zip(todo, pool.map(score, todo)):
            store.append("commits", [(run_id, commit_no, open_batches)])
            left, error = left + open_batches, error or failed
    if left:
        raise RuntimeError(f"{left} batches have no readable answer" + (f"; one error was {error}" if error else ""))


def execute_run(
    store: Store,
    run_id: int,
    postings: DataFrame,
    scorer,
    started_at: str,
    finished_at: str,
    profile: str = "",
    batches_per_commit: int | None = None,
    parallel_commits: int = 4,
    concurrency: int | None = None,
) -> DataFrame:
    """Run once over ``postings`` ``(seq, posting columns)``; returns the run result.

    Sightings are stored before any scoring, and answers and scores group by group. A run
    that died or failed is restarted under its id: stored postings, batches, answers and
    commits are used again, and only batches without a readable answer are scored. A run
    with such batches left fails; their postings count as unscored for later runs. A
    finished run is not run again.
    """
    day = started_at[:10]
    ended = store.read("run_events").where((F.col("run_id") == run_id) & (F.col("kind") == "finish"))
    if ended.where("status = 'ok'").limit(1).count():
        raise ValueError(f"run {run_id} is finished")
    store.append("run_events", [(run_id, "start", started_at, None, None, None, None)])
    try:
        seen = store.sightings(run_id) if is_planned(store, run_id) else store.write_sightings(run_id, day, postings)
        if seen.isEmpty():
            raise RuntimeError("no postings found: check the search queries and the configured sources")
        inputs = plan_inputs(store, run_id, batches_per_commit)
        score_all(store, run_id, scorer, day, profile, parallel_commits, concurrency)
    except BaseException:
        store.append("run_events", [(run_id, "finish", finished_at, "failed", None, None, None)])
        raise
    scored = run_results(store, run_id)
    result = views.run_result(seen, inputs, scored, ("batch", "result_no"))
    # One row by contract: kept, so that a caller's use does not read all answers again.
    row = store.spark.createDataFrame([result.first()], result.schema)
    counts = row.select("raw_total", "new_count", "above_threshold").first()
    store.append("run_events", [(run_id, "finish", finished_at, "ok", *counts)])
    return row


def run_results(store: Store, run_id: int) -> DataFrame:
    """Every result a run's scorer returned, as returned."""
    answers = store.read("answers").where(F.col("run_id") == run_id)
    results = scoring.parse_answers(answers)
    return results.select(
        "batch", "result_no", "r.title", "r.company", "r.url", "r.verdict",
        scoring.fields.score_cast(F.col("r.score")).alias("score"), "data",
    )


def write_exports(store: Store, run_id: int) -> None:
    """Cumulative exports, and the run's own raw postings and results."""
    current = store.state()
    export_objects(state.scored_export(current).select("data"), os.path.join(store.root, "exports", "jobs"))
    export_json(state.seen_export(current), os.path.join(store.root, "exports", "seen"))
    queries = store.read("search_plans").where(F.col("run_id") == run_id)
    store.write_snapshot_files(run_id, "search_config", queries.orderBy("query_no"))
    store.write_snapshot_files(run_id, "raw_jobs", store.sightings(run_id).orderBy("seq"))
    store.write_snapshot_files(run_id, "jobs", run_results(store, run_id).orderBy("batch", "result_no"))


