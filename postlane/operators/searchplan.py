"""Search plans: one query per board and per group for every profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the word that every query must contain.
REQUIRED_WORD = "remote"
# Queries and wanted targets that a task counts together, a few hundred bytes each.
MARKS_PER_TASK = 500_000


def _targets(config: dict) -> Column:
    """The configured boards and groups, in order, as an array of structs."""

    def target(kind, name, sites, extra):
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("target"),
            F.lit(sites).alias("sites"),
            F.lit(extra).alias("extra"),
        )

    boards = [target("board", b, f"site:{b}", "") for b in config.get("job_boards", [])]
    groups = [
        target(
            "group",
            g["name"],
            "(" + " OR ".join(f"site:reddit.com/r/{s}" for s in g.get("subreddits", [])) + ")",
            g.get("extra_terms", ""),
        )
        for g in config.get("reddit_groups", [])
    ]
    return F.array(*boards, *groups)


def expand_targets(profiles: DataFrame, config: dict) -> DataFrame:
    """Every profile with every configured target.

    The targets are a few constants, so they are exploded inside the row.
    """
    return profiles.select("*", F.posexplode(_targets(config)).alias("query_no", "t")).select(
        *profiles.columns, "query_no", "t.*"
    )


def search_plan(profiles: DataFrame, config: dict) -> DataFrame:
    """Queries ``(profile_id, query_no, kind, target, query)`` from ``(roles, skills)``."""

    def quoted(c):
        return F.transform(c, lambda s: F.when(s.contains(" "), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s))

    roles = F.concat(F.lit("("), F.array_join(quoted(F.col("roles")), " OR "), F.lit(")"))
    skills = F.nullif(F.array_join(quoted(F.col("skills")), " "), F.lit(""))
    query = F.concat_ws(
        " ", F.col("sites"), roles, skills, F.nullif(F.col("extra"), F.lit("")), F.lit(REQUIRED_WORD)
    )
    return expand_targets(profiles, config).select(
        "profile_id", "query_no", "kind", "target", query.alias("query")
    )


def plan_violations(plans: DataFrame, profiles: DataFrame, config: dict) -> DataFrame:
    """Broken plan rules: targets without exactly one query, queries without the word.

    ``plans`` is ``(profile_id, kind, target, query)``. Queries and wanted targets are marks
    of one table that is counted by target. Nearly all marks are alone in their map task, so
    they are dealt by target first, as many to a task as its memory easily counts, whatever
    the tables' size. A null never equals another, so marks with one stay on their own side.
    """
    key = ["profile_id", "kind", "target"]
    wanted = expand_targets(profiles.select("profile_id"), config).select(*key)
    without = F.coalesce(~F.lower(F.col("query")).contains(REQUIRED_WORD), F.lit(False))
    marks = plans.select(*key, F.lit(False).alias("_wanted"), without.alias("_without")).unionByName(
        wanted.select(*key, F.lit(True).alias("_wanted"), F.lit(False).alias("_without"))
    )
    n_targets = len(config.get("job_boards", [])) + len(config.get("reddit_groups", []))
    # A plan has about one query per target.
    n_tasks = 2 * profiles.count() * n_targets // MARKS_PER_TASK + 1
    tasks = max(n_tasks, profiles.sparkSession.sparkContext.defaultParallelism)
    has_null = F.col("profile_id").isNull() | F.col("kind").isNull() | F.col("target").isNull()
    counted = (
        marks.repartition(tasks, *key)
        .groupBy(*key, F.when(has_null, F.col("_wanted")).alias("_side"))
        .agg(
            F.count_if("_wanted").alias("_times"),
            F.count_if(~F.col("_wanted")).alias("n_queries"),
            F.count_if("_without").alias("n_without_word"),
        )
    )
    n, is_wanted = F.col("n_queries"), F.col("_times") > 0
    rules = F.array_compact(
        F.array(
            F.when(~is_wanted, F.lit("unknown_target")),
            F.when(is_wanted & (n == 0), F.lit("missing_query")),
            F.when(is_wanted & (n > 1), F.lit("repeated_query")),
            F.when(F.col("n_without_word") > 0, F.lit("word_missing")),
        )
    )
    broken = counted.withColumn("_rules", rules).where(F.size("_rules") > 0)
    # A repeated profile wants its targets as often.
    each = broken.withColumn("_time", F.explode(F.sequence(F.lit(1), F.greatest("_times", F.lit(1)))))
    return each.select(*key, "n_queries", F.explode("_rules").alias("rule"))
