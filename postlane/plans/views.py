"""Dashboard views, run results, digests and run-to-run differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions.pay import salary_value
from postlane.functions.text import first_nonempty, or_blank


def jobs_with_status(jobs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Jobs with the status marked for exactly their URL, ``none`` if there is none."""
    marked = statuses.select("url", "status")
    return jobs.drop("status").join(marked, "url", "left").withColumn(
        "status", F.coalesce("status", F.lit("none"))
    )


def _collated(c: str) -> Column:
    return F.collate(or_blank(F.col(c)), "UNICODE")


def _score() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


SORTS = {
    "score-desc": lambda: _score().desc(),
    "score-asc": lambda: _score().asc(),
    "company-asc": lambda: _collated("company").asc(),
    "salary-desc": lambda: salary_value(F.col("salary")).desc(),
    "location-asc": lambda: _collated("location").asc(),
}


def dashboard_view(
    jobs: DataFrame, verdict: str = "all", sort: str = "score-desc", tie_break: tuple = ("url",)
) -> DataFrame:
    """Jobs of one verdict in one of the dashboard's orders."""
    shown = jobs if verdict == "all" else jobs.where(F.col("verdict") == verdict)
    return shown.orderBy(SORTS[sort](), *[F.col(c) for c in tie_break])


def above_threshold(jobs: DataFrame) -> DataFrame:
    return jobs.where(_score() >= settings.SCORE_THRESHOLD)


def top_jobs(jobs: DataFrame, order: tuple = ("ord",), k: int = settings.TOP_POSTINGS) -> DataFrame:
    """The ``k`` best-scored jobs; equal scores keep their order."""
    return jobs.orderBy(_score().desc(), *[F.col(c) for c in order]).limit(k)


def run_counters(raw: DataFrame, new: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: postings seen, sent for scoring, scored, and above the threshold."""

    def one(df, **counts):
        return df.agg(*[c.alias(name) for name, c in counts.items()])

    total = F.count(F.lit(1))
    parts = [
        one(raw, raw_total=total),
        one(new, new_count=total),
        one(scored, total=total, above_threshold=F.count_if(_score() >= settings.SCORE_THRESHOLD)),
    ]
    return _one_row(parts, ["raw_total", "new_count", "total", "above_threshold"])


def _one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Single-row frames with different columns side by side, without a join."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])


def top_jobs_array(jobs: DataFrame, order: tuple = ("ord",)) -> DataFrame:
    """One row with the top jobs as an array in order (at most ``TOP_POSTINGS`` items)."""
    top = top_jobs(jobs, order).select(
        _score().alias("score"),
        *order,
        or_blank(F.col("title")).alias("title"),
        or_blank(F.col("company")).alias("company"),
        or_blank(F.col("url")).alias("url"),
    )
    item = F.struct(
        (-F.col("score")).alias("rank"), *order, F.struct("title", "company", "score", "url").alias("job")
    )
    listed = F.array_sort(F.collect_list(item))
    return top.agg(F.transform(listed, lambda x: x["job"]).alias("top_jobs"))


def run_result(raw: DataFrame, new: DataFrame, scored: DataFrame, order: tuple = ("ord",)) -> DataFrame:
    """One row: the counters of a run and its top jobs."""
    counters = run_counters(raw, new, scored)
    return _one_row([counters, top_jobs_array(scored, order)], [*counters.columns, "top_jobs"])


def _named(title: Column, company: Column):
    return (
        F.coalesce(first_nonempty(title), F.lit("(untitled)")),
        F.coalesce(first_nonempty(company), F.lit("(unknown company)")),
    )


def _plain_score(score: Column) -> Column:
    """Scores print without a fraction where they have none."""
    whole = score == F.floor(score)
    return F.when(whole, score.cast("long").cast("string")).otherwise(score.cast("string"))


def digest(result: DataFrame) -> DataFrame:
    """The run result as text: ``lines`` for a mail or log, ``body`` for a notification."""

    def line(job, i):
        title, company = _named(job["title"], job["company"])
        return F.concat(
            (i + 1).cast("string"), F.lit(". "), title, F.lit(" - "), company,
            F.lit(" - score "), _plain_score(job["score"]), F.lit(" - "), job["url"],
        )

    best = F.try_element_at(F.col("top_jobs"), F.lit(1))
    title, company = _named(best["title"], best["company"])
    limit = F.lit(str(settings.SCORE_THRESHOLD))
    counts = [
        F.concat(F.lit(settings.DIGEST_RAW), F.col("raw_total").cast("string")),
        F.concat(F.lit(settings.DIGEST_NEW), F.col("new_count").cast("string")),
        F.concat(F.lit(settings.DIGEST_SCORED), limit, F.lit(": "), F.col("above_threshold").cast("string")),
        F.lit(""),
    ]
    listed = F.array_join(F.transform("top_jobs", line), "\n")
    n = F.size("top_jobs")
    top = F.when(n > 0, F.concat(F.lit("Top "), n.cast("string"), F.lit(" job(s):\n"), listed)).otherwise(
        F.lit(settings.DIGEST_NONE)
    )
    body = F.concat(
        F.col("new_count").cast("string"), F.lit(" new job(s), "),
        F.col("above_threshold").cast("string"), F.lit(" scored >= "), limit,
    )
    named = F.concat(
        F.lit(". Top: "), title, F.lit(" @ "), company, F.lit(" ("), _plain_score(best["score"]), F.lit(")")
    )
    return result.select(
        F.concat_ws("\n", *counts, top).alias("lines"),
        F.concat(body, F.when(n > 0, named).otherwise("")).alias("body"),
    )


def run_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Keys added, dropped or rescored between two runs' results ``(dedup_key, score)``."""
    a = older.select("dedup_key", F.col("score").alias("old_score"), F.lit(True).alias("_old"))
    b = newer.select("dedup_key", F.col("score").alias("new_score"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("dropped"))
        .when(~F.col("old_score").eqNullSafe(F.col("new_score")), F.lit("rescored"))
    )
    return (
        a.join(b, "dedup_key", "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .drop("_old", "_new")
    )
