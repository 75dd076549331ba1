"""Cross-run state: event logs folded into one row per posting, run or URL.

Nothing is updated in place. Runs append to logs (see ``sources.tables``), and the
functions here fold a log, or merge a fold of new events into an older state. The
order of events is ``(run_id, phase, batch, seq)``: all sightings of a run come
before its scores, and a batch's results before the marks of its omitted inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import fields, urls
from postlane.functions.text import or_blank
from postlane.operators.ordering import next_in_order

SEEN, SCORED, OMITTED = 0, 1, 2
ORDER = ["run_id", "phase", "batch", "seq"]
DESCRIPTIVE = ["title", "company", "source", "location", "salary"]
EVENT_COLUMNS = [
    "dedup_key",
    *ORDER,
    "day",
    "url",
    *DESCRIPTIVE,
    "score",
    "verdict",
    "data",
]


def sighting_events(postings: DataFrame) -> DataFrame:
    """Sightings ``(run_id, seq, day, posting columns)`` as events; blank URLs are skipped.

    A posting without salary is stored with a blank one.
    """
    return (
        postings.where(F.length("url") > 0)
        .withColumn("salary", F.coalesce("salary", F.lit("")))
        .withColumn("dedup_key", urls.dedup_key(F.col("url")))
        .withColumn("phase", F.lit(SEEN))
        .withColumn("batch", F.lit(0).cast("long"))
        .withColumn("score", F.lit(None).cast("double"))
        .withColumn("verdict", F.lit(None).cast("string"))
        .withColumn("data", F.lit(None).cast("string"))
        .select(*EVENT_COLUMNS)
    )


def fold_events(events: DataFrame) -> DataFrame:
    """One summary row per key: first and last events of each kind.

    Summaries are combined on the map side, so a key with very many events is cheap.
    """
    order = F.struct(*ORDER)
    insert = F.col("phase") != OMITTED

    def pick(condition, *columns):
        return F.when(condition, F.struct(*columns))

    described = ["run_id", "day", *DESCRIPTIVE]
    return events.groupBy("dedup_key").agg(
        F.min_by(
            F.struct("url", "salary", "day", *ORDER), F.when(insert, order)
        ).alias("first_insert"),
        F.max_by(F.struct(*described), F.when(insert, order)).alias("last_insert"),
        F.max_by(
            F.struct("score", "verdict", "data", "run_id"),
            F.when(F.col("phase") == SCORED, order),
        ).alias("last_score"),
        F.max(pick(~insert, *ORDER, "day")).alias("last_omit"),
        F.max_by("salary", F.when(insert & (F.col("salary") != ""), order)).alias("salary_text"),
        F.count_if(F.col("phase") == SEEN).alias("n_seen"),
    )


def empty_state(events: DataFrame) -> DataFrame:
    from postlane.schemas import STATE

    return events.sparkSession.createDataFrame([], STATE)


def _state_columns(has_old):
    """State columns from an old state row ``o`` (if any) and a summary ``n`` (if any)."""
    old, new = "o.", "n."
    first, last, score = f"{new}first_insert", f"{new}last_insert", f"{new}last_score"
    omit = F.col(f"{new}last_omit")
    has_insert = F.col(first).isNotNull()
    first_order = F.struct(*[F.col(f"{first}.{c}") for c in ORDER])
    omit_order = F.struct(*[omit[c] for c in ORDER])
    # A mark only touches an existing row: it counts after the row's first insert.
    marked = omit.isNotNull() & (has_old | (omit_order > first_order))
    mark_is_last = marked & (
        ~has_insert
        | (F.struct(omit["run_id"]) >= F.struct(F.col(f"{last}.run_id")))
    )

    def keep_old(c):
        return F.col(f"{old}{c}")

    def described(c):
        return F.when(has_insert, F.col(f"{last}.{c}")).otherwise(keep_old(c))

    has_score = F.col(score).isNotNull()
    last_seen = F.when(mark_is_last, omit["day"]).otherwise(described_as(last, old, "day", "last_seen", has_insert))
    last_seen_run = F.when(mark_is_last, omit["run_id"]).otherwise(
        described_as(last, old, "run_id", "last_seen_run", has_insert)
    )
    scored_run = F.greatest(
        F.when(has_score, F.col(f"{score}.run_id")),
        F.when(marked, omit["run_id"]),
        keep_old("last_scored_run"),
    )
    started_scored = (F.col(f"{first}.phase") == SCORED).cast("long")
    return [
        F.coalesce(F.col("o.dedup_key"), F.col("n.dedup_key")).alias("dedup_key"),
        F.when(has_old, keep_old("url")).otherwise(F.col(f"{first}.url")).alias("url"),
        *[described(c).alias(c) for c in ["title", "company", "source", "location"]],
        F.coalesce(
            F.col(f"{new}salary_text"),
            F.when(has_old, keep_old("salary")).otherwise(F.col(f"{first}.salary")),
        ).alias("salary"),
        *[
            F.when(has_score, F.col(f"{score}.{c}")).otherwise(keep_old(c)).alias(c)
            for c in ["score", "verdict", "data"]
        ],
        F.when(has_old, keep_old("first_seen")).otherwise(F.col(f"{first}.day")).alias("first_seen"),
        last_seen.alias("last_seen"),
        (
            F.when(has_old, keep_old("runs_seen")).otherwise(started_scored)
            + F.coalesce(F.col(f"{new}n_seen"), F.lit(0))
        ).alias("runs_seen"),
        F.when(has_old, keep_old("first_seen_run"))
        .otherwise(F.col(f"{first}.run_id"))
        .alias("first_seen_run"),
        last_seen_run.alias("last_seen_run"),
        scored_run.alias("last_scored_run"),
        *[
            F.when(has_old, keep_old(f"first_{c}")).otherwise(F.col(f"{first}.{c}")).alias(f"first_{c}")
            for c in ["phase", "batch", "seq"]
        ],
    ]


def described_as(last, old, field, state_field, has_insert):
    return F.when(has_insert, F.col(f"{last}.{field}")).otherwise(F.col(f"{old}{state_field}"))


def advance_state(old: DataFrame | None, events: DataFrame) -> DataFrame:
    """State after ``events``, all of which are later than those behind ``old``.

    Rows without new events stay as they are. New keys whose only events are marks of
    omitted inputs create no row.
    """
    summary = fold_events(events).alias("n")
    if old is None:
        # A first fold needs no join: read the summary with an all-NULL old row.
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in empty_state(events).schema]
        joined = summary.select(
            F.struct(*[F.col(f"n.{c}") for c in summary.columns]).alias("n"),
            F.struct(*blank).alias("o"),
        )
        merged = joined.select(*_state_columns(F.lit(False)))
    else:
        joined = old.alias("o").join(summary, F.col("o.dedup_key") == F.col("n.dedup_key"), "full_outer")
        merged = joined.select(*_state_columns(F.col("o.dedup_key").isNotNull()))
    return merged.where(F.col("first_seen_run").isNotNull() | F.col("runs_seen").isNotNull())


def attempted_keys(state: DataFrame) -> DataFrame:
    """Keys with a result, or that a completed batch has seen."""
    return state.where(F.col("data").isNotNull() | F.col("last_scored_run").isNotNull()).select(
        "dedup_key"
    )


def with_key(postings: DataFrame) -> DataFrame:
    return postings.withColumn("dedup_key", urls.dedup_key(F.col("url")))


def to_score(postings: DataFrame, state: DataFrame) -> DataFrame:
    """Postings (with repeats) that no completed batch has seen yet."""
    return with_key(postings).join(attempted_keys(state), "dedup_key", "left_anti")


def already_scored(postings: DataFrame, state: DataFrame) -> DataFrame:
    """Postings (with repeats) that need no further scoring."""
    return with_key(postings).join(attempted_keys(state), "dedup_key", "left_semi")


# -- runs ---------------------------------------------------------------------


def fold_runs(run_events: DataFrame) -> DataFrame:
    """Run log ``(run_id, kind, at, status, counters)`` to one row per run.

    ``kind`` is start or finish. A run that never finished counts as failed from the
    moment the next run starts; the newest one is still running.
    """
    start = F.col("kind") == "start"
    counters = ["raw_total", "new_count", "above_threshold"]
    runs = run_events.groupBy("run_id").agg(
        F.max(F.when(start, F.col("at"))).alias("started_at"),
        # A later finish replaces an earlier one.
        F.max(F.when(~start, F.struct("at", "status", *counters))).alias("finish"),
    ).where(F.col("started_at").isNotNull())
    followed = next_in_order(runs, "run_id", "started_at", "next_start")
    return _closed_runs(followed)


def _closed_runs(runs: DataFrame) -> DataFrame:
    finished, orphan = F.col("finish").isNotNull(), F.col("next_start").isNotNull()
    return runs.select(
        "run_id",
        "started_at",
        F.when(finished, F.col("finish.at")).otherwise(F.col("next_start")).alias("finished_at"),
        F.when(finished, F.col("finish.status"))
        .when(orphan, F.lit("failed"))
        .otherwise(F.lit("running"))
        .alias("status"),
        *[
            F.col(f"finish.{c}").alias(c)
            for c in ["raw_total", "new_count", "above_threshold"]
        ],
    )


def run_history(run_events: DataFrame, limit: int = settings.RUN_HISTORY_ROWS) -> DataFrame:
    """The newest runs first.

    Closing a run needs only its successor, so the newest ``limit`` starts are taken
    before the fold and the log is folded for those runs alone.
    """
    newest = (
        run_events.where(F.col("kind") == "start")
        .groupBy("run_id")
        .count()
        .select("run_id")
        .orderBy(F.col("run_id").desc())
        .limit(limit)
    )
    # `newest` holds at most `limit` ids.
    recent = run_events.join(F.broadcast(newest), "run_id", "left_semi")
    return fold_runs(recent).orderBy(F.col("run_id").desc()).limit(limit)


# -- status marks -------------------------------------------------------------


def split_marks(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status marks with a known status, and the rejected rest."""
    known = F.coalesce(F.col("status").isin(settings.MARK_STATUSES), F.lit(False))
    return marks.where(known), marks.where(~known)


def latest_status(marks: DataFrame, order: list[str]) -> DataFrame:
    """The last valid mark of every URL; ``none`` clears it."""
    valid, _ = split_marks(marks)
    return (
        valid.groupBy("url")
        .agg(F.max_by("status", F.struct(*order)).alias("status"))
        .where(F.col("status") != "none")
    )


# -- import and export --------------------------------------------------------


def import_legacy(state: DataFrame, seen: DataFrame, scored: DataFrame, today: str) -> DataFrame:
    """State after importing exports of an earlier tool; a no-op unless it is empty.

    ``seen`` is ``(dedup_key, url, title, first_seen, last_seen, runs_seen, seq)``,
    inserted where the key is new. ``scored`` is ``(url, title, company, source,
    location, salary, score, verdict, data, seq)``; it sets score, verdict and data of
    a known key and inserts other keys whole, the first of them winning for the rest.
    """
    if not state.isEmpty():
        return state
    from postlane.schemas import STATE

    first_seen_row = seen.groupBy("dedup_key").agg(
        F.min_by(F.struct("url", "title", "first_seen", "last_seen", "runs_seen", "seq"), "seq").alias("s")
    )
    keyed = scored.where(F.length("url") > 0).withColumn("dedup_key", urls.dedup_key(F.col("url")))
    results = keyed.groupBy("dedup_key").agg(
        F.min_by(F.struct("url", *DESCRIPTIVE, "seq"), "seq").alias("f"),
        F.max_by(F.struct("score", "verdict", "data"), "seq").alias("l"),
    )
    known = F.col("s").isNotNull()

    def pick(seen_value, result_value):
        return F.when(known, seen_value).otherwise(result_value)

    none = F.lit(None).cast("string")
    values = {
        "dedup_key": F.col("dedup_key"),
        "url": pick(F.col("s.url"), F.col("f.url")),
        "title": pick(F.col("s.title"), F.col("f.title")),
        **{c: pick(none, F.col(f"f.{c}")) for c in ["company", "source", "location", "salary"]},
        "score": fields.score_cast(F.col("l.score")),
        "verdict": F.col("l.verdict"),
        "data": F.col("l.data"),
        "first_seen": pick(F.col("s.first_seen"), F.lit(today)),
        "last_seen": pick(F.col("s.last_seen"), F.lit(today)),
        "runs_seen": pick(F.col("s.runs_seen"), F.lit(1)),
        # Rows keep the order of the import: seen rows, then inserted results.
        "first_phase": pick(F.lit(SEEN), F.lit(SCORED)),
        "first_batch": F.lit(0),
        "first_seq": pick(F.col("s.seq"), F.col("f.seq")),
    }
    joined = first_seen_row.join(results, "dedup_key", "full_outer")
    return joined.select(
        *[
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in STATE
        ]
    )


def seen_export(state: DataFrame) -> DataFrame:
    """Key, first URL, title and sighting dates of every posting, blank for NULL."""
    return state.select(
        "dedup_key",
        "url",
        *[or_blank(F.col(c)).alias(c) for c in ["title", "first_seen", "last_seen"]],
        "runs_seen",
    )


FIRST_ORDER = ["first_seen_run", "first_phase", "first_batch", "first_seq"]


def scored_export(state: DataFrame, run_id: int | None = None) -> DataFrame:
    """Stored results in the order their postings first appeared, or one run's results."""
    scored = state.where(F.col("data").isNotNull())
    if run_id is not None:
        scored = scored.where(F.col("last_scored_run") == run_id)
    return scored.orderBy(*[F.col(c).asc_nulls_first() for c in FIRST_ORDER])
