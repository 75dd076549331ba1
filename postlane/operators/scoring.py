"""Scoring: batches, an external scorer, result matching, a feature scorer."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane import settings
from postlane.functions import fields, text, urls
from postlane.functions.model_json import model_json
from postlane.functions.text import first_nonempty, or_blank, title_key
from postlane.operators.ordering import global_position, top_per_group
from postlane.operators.state import OMITTED, SCORED
from postlane.schemas import POSTING_COLUMNS, SCORED as SCORED_SCHEMA
from postlane.session import materialize

# -- batches ------------------------------------------------------------------


def assign_batches(postings: DataFrame, order: list[str], size: int = settings.SCORE_BATCH_SIZE) -> DataFrame:
    """Position ``idx`` in the run, ``batch`` number and ``pos`` inside the batch."""
    indexed = global_position(postings, order)
    return indexed.withColumn("batch", F.floor(F.col("idx") / size).cast("long")).withColumn(
        "pos", (F.col("idx") % size).cast("int")
    )


def batch_payloads(batched: DataFrame) -> DataFrame:
    """One row per batch: the batch's postings in order, as a JSON array.

    A batch has a fixed small number of postings, so the collected list is bounded.
    """
    item = F.struct("pos", F.struct(*POSTING_COLUMNS).alias("posting"))
    ordered = F.array_sort(F.collect_list(item))
    return batched.groupBy("run_id", "batch").agg(ordered.alias("items")).select(
        "run_id",
        "batch",
        F.size("items").alias("n_postings"),
        F.to_json(F.transform("items", lambda x: x["posting"])).alias("payload"),
    )


Scorer = Callable[[str, str, str], str]

# Characters of a payload that go to Python in one row: 2 MB in the 10,000 rows of a batch.
PIECE_CHARS = 200


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls an external scorer.

    A call that takes longer than ``time_limit_s`` counts as a network error. Network errors
    and the status codes in ``settings.RETRY_CODES`` are tried again after ``backoff_s``, up
    to ``attempts`` calls; any other error is final.
    """

    in_flight: int = 4
    time_limit_s: float = settings.CALL_TIME_LIMIT
    attempts: int = settings.CALL_ATTEMPTS
    backoff_s: float = settings.CALL_BACKOFF


def worth_retrying(error: BaseException) -> bool:
    """Whether an error may pass: by its status code if it has one, else if it is of the network."""
    code = getattr(error, "code", getattr(error, "status", None))
    if isinstance(code, int):
        return code in settings.RETRY_CODES
    return isinstance(error, OSError)


def within_time(call: Callable[[], str], limit_s: float) -> str:
    """The call's result, or a ``TimeoutError``; a call that hangs is left behind as a daemon."""
    done: list = []

    def run() -> None:
        try:
            done.append((call(), None))
        except BaseException as error:  # noqa: BLE001 - handed over to the waiting thread
            done.append((None, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(limit_s)
    if not done:
        raise TimeoutError(f"no answer within {limit_s:g} s")
    result, error = done[0]
    if error is not None:
        raise error
    return result


def answered(call: Callable[[], str], policy: CallPolicy) -> tuple[str | None, str | None]:
    """The answer and the error of a call under a policy, one of them null."""
    for attempt in range(1, policy.attempts + 1):
        try:
            return within_time(call, policy.time_limit_s), None
        except Exception as error:  # noqa: BLE001 - whatever a user's scorer raises
            if not worth_retrying(error):
                return None, f"{type(error).__name__}: {error}"
            if attempt == policy.attempts:
                return None, f"{type(error).__name__}: {error} (after {attempt} attempts)"
        time.sleep(policy.backoff_s)
    return None, None


def in_order(calls: Iterator, run: Callable, in_flight: int) -> Iterator:
    """Results of ``run`` over ``calls`` in their order, so many at a time at most."""
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        for call in calls:
            waiting.append(pool.submit(run, call))
            if len(waiting) >= in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def in_pieces(payloads: DataFrame) -> DataFrame:
    """Payloads cut into rows of at most ``PIECE_CHARS`` characters, a payload's pieces in a row.

    A batch of rows for Python is bounded by their number alone; so cut, also by its size.
    ``first`` marks where a payload begins; a null or an empty one is one piece.
    """
    cut = F.regexp_extract_all("payload", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    pieces = F.when(F.col("payload") == "", F.array(F.lit(""))).otherwise(cut)
    placed = payloads.select("run_id", "batch", F.posexplode_outer(pieces).alias("no", "piece"))
    return placed.select("run_id", "batch", (F.coalesce("no", F.lit(0)) == 0).alias("first"), "piece")


def put_together(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows ``(run_id, batch, payload)`` of frames of pieces."""
    key, pieces = None, []
    for frame in frames:
        for run_id, batch, first, piece in zip(frame["run_id"], frame["batch"], frame["first"], frame["piece"]):
            if first:
                if key:
                    yield *key, None if pieces == [None] else "".join(pieces)
                key, pieces = (run_id, batch), []
            pieces.append(piece)
    if key:
        yield *key, None if pieces == [None] else "".join(pieces)


def call_scorer(
    payloads: DataFrame,
    scorer: Scorer,
    today: str,
    profile: str,
    concurrency: int | None = None,
    policy: CallPolicy = CallPolicy(),
) -> DataFrame:
    """Answers ``(run_id, batch, raw, error)`` of an external scorer, one call per batch.

    ``scorer(payload_json, today, profile)`` returns the answer text. What it raises in the
    end becomes the row's ``error``, so a failed call costs no other call's answer. Batches
    are dealt over ``concurrency`` tasks (one per core by default), a number that adaptive
    execution does not change: rows are tiny and calls slow. A task has
    ``policy.in_flight`` calls open at a time, as calls mostly wait; so the scorer has to be
    safe to call from several threads. A retried task may call the scorer twice, so write
    the result keyed by ``(run_id, batch)`` before reading it again.
    """
    tasks = concurrency or payloads.sparkSession.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = lambda row: (row[:2], answered(lambda: scorer(row[2], today, profile), policy))
        for (run_id, batch), (raw, error) in in_order(put_together(frames), ask, policy.in_flight):
            yield pd.DataFrame({"run_id": [run_id], "batch": [batch], "raw": [raw], "error": [error]})

    # Round-robin: neither keys nor sizes decide, every task gets its share of calls.
    dealt = payloads.select("run_id", "batch", "payload").repartition(tasks)
    return in_pieces(dealt).mapInPandas(run, "run_id long, batch long, raw string, error string")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Raw answers ``(run_id, batch, raw)`` to one row per result.

    ``result_no`` is the place in the answer, ``data`` the result's JSON text and ``r``
    its fields. An unreadable answer gives no row.
    """
    # A generator's output: a filter on it is not pushed below, where Python would read every
    # answer twice, by two workers in each task.
    value = answers.select("run_id", "batch", F.explode(F.array(result_array(F.col("raw")))).alias("value"))
    return value.where(F.col("value").isNotNull()).select(
        "run_id", "batch", F.posexplode(F.from_json("value", "array<string>")).alias("result_no", "data")
    ).withColumn("r", F.from_json("data", SCORED_SCHEMA))


def result_array(raw: Column) -> Column:
    """JSON text of an answer that holds an array; NULL for anything else.

    The one test of readability: parsing, quarantine and omission all go by it.
    """
    value = model_json(raw)
    return F.when(value.startswith("["), value)


def readable_answers(answers: DataFrame) -> DataFrame:
    return answers.where(result_array(F.col("raw")).isNotNull())


def unreadable_answers(answers: DataFrame) -> DataFrame:
    """Answers without an array of results: prose, other JSON, or none at all."""
    return answers.where(result_array(F.col("raw")).isNull())


def batches_to_retry(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """Batches ``(run_id, batch)`` of the inputs that have no readable answer yet."""
    answered = readable_answers(answers).select("run_id", "batch")
    return inputs.select("run_id", "batch").distinct().join(answered, ["run_id", "batch"], "left_anti")


# -- matching -----------------------------------------------------------------

_INPUT_FIELDS = ["url", "title", "company", "source", "location", "salary"]


def match_results(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Each result with the input it belongs to.

    Tried in order inside the result's batch: the same dedup key, the same title, the
    same place in the batch. ``tier`` says which one hit. The stored key is the
    input's, even if the result names another URL; results without any URL are dropped.

    ``inputs`` has ``(run_id, batch, pos)`` and posting columns. A batch's inputs are
    few, so they travel as one array per batch: a single join serves all three tiers.
    """
    item = F.struct(
        "pos",
        F.when(F.length("url") > 0, urls.dedup_key(F.col("url"))).alias("key"),
        F.nullif(title_key(F.col("title")), F.lit("")).alias("title_key"),
        *[F.col(c) for c in _INPUT_FIELDS],
    )
    per_batch = inputs.groupBy("run_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("inputs"))
    result_key = F.when(F.length("r.url") > 0, urls.dedup_key(F.col("r.url")))
    result_title = F.nullif(title_key(F.col("r.title")), F.lit(""))

    def first(field, wanted):
        same = F.filter("inputs", lambda x: x[field] == wanted)
        return F.try_element_at(same, F.lit(1))

    keyed = (
        results.withColumn("_key", result_key)
        .withColumn("_title", result_title)
        .join(per_batch, ["run_id", "batch"], "left")
        .withColumn("_by_key", first("key", F.col("_key")))
        .withColumn("_by_title", first("title_key", F.col("_title")))
        .withColumn("_by_place", first("pos", F.col("result_no")))
    )
    matched = F.coalesce("_by_key", "_by_title", "_by_place")
    tier = (
        F.when(F.col("_by_key").isNotNull(), F.lit("url"))
        .when(F.col("_by_title").isNotNull(), F.lit("title"))
        .when(F.col("_by_place").isNotNull(), F.lit("position"))
        .otherwise(F.lit("unmatched"))
    )
    url = F.coalesce(first_nonempty(F.col("input.url"), F.col("r.url")), F.lit(""))
    return (
        keyed.withColumn("input", matched)
        .withColumn("tier", tier)
        .withColumn("url", url)
        .where(F.col("url") != "")
        .withColumn("dedup_key", urls.dedup_key(F.col("url")))
        .select(
            "run_id",
            "batch",
            "result_no",
            "dedup_key",
            "url",
            "tier",
            F.col("input.pos").alias("input_pos"),
            *[
                or_blank(first_nonempty(F.col(f"r.{c}"), F.col(f"input.{c}"))).alias(c)
                for c in ["title", "company", "source", "location", "salary"]
            ],
            fields.score_cast(F.col("r.score")).alias("score"),
            or_blank(F.col("r.verdict")).alias("verdict"),
            "data",
        )
    )


def omitted_inputs(inputs: DataFrame, matched: DataFrame, answered: DataFrame) -> DataFrame:
    """Inputs of answered batches that no result of their batch belongs to.

    ``answered`` lists the batches ``(run_id, batch)`` with a readable answer, once each.
    Inputs of other batches are not omitted but still to be scored.
    """
    open_or_not = inputs.where(F.length("url") > 0).join(answered.select("run_id", "batch"), ["run_id", "batch"], "left_semi")
    keyed = open_or_not.withColumn("dedup_key", urls.dedup_key(F.col("url")))
    keys = matched.select("run_id", "batch", "dedup_key").distinct()
    return keyed.join(keys, ["run_id", "batch", "dedup_key"], "left_anti")


def score_events(matched: DataFrame, omitted: DataFrame, day: Column) -> DataFrame:
    """Matched results and omitted inputs as state events."""
    results = matched.withColumn("phase", F.lit(SCORED)).withColumn("seq", F.col("result_no").cast("long"))
    marks = omitted.withColumn("phase", F.lit(OMITTED)).withColumn("seq", F.col("pos").cast("long"))
    columns = ["dedup_key", "run_id", "phase", "batch", "seq", "url", "title", "company", "source",
               "location", "salary"]
    none = F.lit(None)
    scored = results.select(*columns, "score", "verdict", "data")
    left_out = marks.select(
        *columns,
        none.cast("double").alias("score"),
        none.cast("string").alias("verdict"),
        none.cast("string").alias("data"),
    )
    return scored.unionByName(left_out).withColumn("day", day)


def unfinished_batches(inputs: DataFrame, attempted: DataFrame) -> DataFrame:
    """Inputs still to be scored after a crash: those no committed batch has seen.

    ``attempted`` holds the dedup keys of committed batches, results and marks alike.
    """
    keyed = inputs.withColumn("dedup_key", urls.dedup_key(F.col("url")))
    return keyed.join(attempted.select("dedup_key").distinct(), "dedup_key", "left_anti")


# -- contract checks ----------------------------------------------------------


def contract_violations(results: DataFrame) -> DataFrame:
    """Results that break the scorer's contract, one row per result and broken rule.

    ``results`` has ``score, verdict, salary`` of the result and ``input_salary,
    input_description`` of its input. A stated salary must occur in the input.
    """
    score = fields.score_cast(F.col("score"))
    stated = or_blank(F.col("salary"))
    grounded = F.contains(or_blank(F.col("input_salary")), stated) | F.contains(
        or_blank(F.col("input_description")), stated
    )
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(~score.between(0, 100), F.lit(True)), F.lit("score_range")),
            F.when(F.coalesce(score < settings.SCORE_THRESHOLD, F.lit(False)), F.lit("below_threshold")),
            F.when(
                F.coalesce(~F.col("verdict").isin(settings.VERDICTS), F.lit(True)), F.lit("verdict")
            ),
            F.when((stated != "") & ~grounded, F.lit("salary_not_in_input")),
        )
    )
    return results.withColumn("rule", F.explode(rules))


# -- feature scorer -----------------------------------------------------------

WORD_BREAK = r"[^\p{L}\p{N}+#]+"


def words_of(*texts: str) -> Column:
    """Lower-case words of some text columns, with repeats."""
    return F.split(F.lower(F.concat_ws(" ", *texts)), WORD_BREAK)


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def skill_points(shared: Column, wanted: Column) -> Column:
    return F.lit(60.0) * shared / F.greatest(wanted, F.lit(1))


def posting_points(df: DataFrame, today: Column, remote_words: list[str], flag_words: list[str]) -> DataFrame:
    """Adds the profile-independent features of postings with a ``words`` array."""
    return (
        df.withColumn("remote", F.arrays_overlap("words", _literal(remote_words)))
        .withColumn("fresh", fields.is_fresh(F.col("posted_date").try_cast("date"), today))
        .withColumn("red_flags", F.array_sort(F.array_intersect("words", _literal(flag_words))))
        .withColumn(
            "base_points",
            F.col("remote").cast("int") * 20 + F.col("fresh").cast("int") * 20 - F.size("red_flags") * 10,
        )
    )


def final_score(points: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)), 4)


def score_verdict(score: Column) -> Column:
    return (
        F.when(score >= settings.BAND_HIGH, F.lit("apply"))
        .when(score >= settings.BAND_MID, F.lit("review"))
        .otherwise(F.lit("skip"))
    )


def feature_score(
    postings: DataFrame,
    skills: list[str],
    today: Column,
    remote_words: list[str],
    flag_words: list[str],
) -> DataFrame:
    """Deterministic score of every posting for one profile.

    Up to 60 points for the share of the profile's skills the posting names, 20 for a
    remote signal, 20 for freshness, less 10 per red flag, kept within 0 to 100.
    """
    # One pass over a posting's words keeps the few that any feature looks at.
    known = _literal(sorted({*skills, *remote_words, *flag_words}))
    described = postings.withColumn("words", F.array_intersect(words_of("title", "description"), known))
    featured = posting_points(described, today, remote_words, flag_words)
    reasons = F.array_sort(F.array_intersect("words", _literal(skills)))
    score = final_score(skill_points(F.size("match_reasons"), F.lit(len(skills))) + F.col("base_points"))
    return (
        featured.withColumn("match_reasons", reasons)
        .withColumn("score", score)
        .withColumn("verdict", score_verdict(F.col("score")))
        .drop("words", "base_points")
    )


def candidate_pairs(sets: DataFrame, groups: DataFrame, posting_id: str, k: int) -> DataFrame:
    """Pairs of skill sets and posting groups among which are the ``k`` best of every set.

    ``sets`` has ``set_id`` and ``skill_set``, ``groups`` one row per signature and base points
    with the first ``ids``. A threshold algorithm over the list of groups under each word:

    The heads, the ``k`` groups with the smallest ids under each word and base points, meet
    all sets with the word. Whatever shares only one word with a set stands behind the heads
    of that word, which score no less and come first. The ``k``-th best score among a set's
    heads tells how many words any other group has to share, two at least, to be better;
    such a group has one of the set's rarest words, all but so many less one. So a word that
    nearly all groups and sets have brings only its heads together with the sets.
    """
    lists = groups.select("signature", "base_points", F.array_min("ids").alias("_first"), F.explode("signature").alias("word"))
    often = lists.groupBy("word").agg(F.count(F.lit(1)).alias("_often"))
    # A set is one person's skills, so a window over it is small.
    by_rarity = Window.partitionBy("set_id").orderBy("_often", "word")
    set_words = materialize(
        sets.select("set_id", F.size("skill_set").alias("wanted"), F.explode("skill_set").alias("word"))
        .join(often, "word", "left")
        .withColumn("_often", F.coalesce("_often", F.lit(0)))
        .withColumn("_rare", F.row_number().over(by_rarity))
    )
    heads = top_per_group(lists, ["word", "base_points"], [F.col("_first")], k, "_nth")

    def met(pairs: DataFrame) -> DataFrame:
        """The distinct pairs with the words they share and the groups' ids."""
        named = pairs.select("set_id", "signature", "base_points").distinct().join(sets, "set_id")
        shared = F.size(F.array_intersect("signature", "skill_set")).cast("bigint")
        return named.withColumn("n_shared", shared).join(groups, ["signature", "base_points"])

    first = materialize(met(set_words.join(heads, "word")))
    points = skill_points(F.col("n_shared"), F.size("skill_set")) + F.col("base_points")
    listed = first.select("set_id", final_score(points).alias("_least"), F.explode("ids").alias(posting_id))
    ranked = top_per_group(listed, ["set_id"], [F.col("_least").desc(), F.col(posting_id)], k, "_place")
    # Sets without a k-th best have met all there is for them.
    bound = ranked.where(F.col("_place") == k).select("set_id", "_least")
    highest = groups.agg(F.max("base_points")).first()[0]

    def is_rare_enough(base: Column) -> Column:
        # As scores are rounded, a little less will do.
        missing = (F.col("_least") - 0.0001 - base) * F.col("wanted") / 60
        needed = F.greatest(F.ceil(missing), F.lit(2))
        return F.col("_rare") <= F.col("wanted") - needed + 1

    probes = set_words.join(bound, "set_id").where(is_rare_enough(F.lit(highest)))
    later = probes.join(lists, "word").where(is_rare_enough(F.col("base_points")))
    return first.unionByName(met(later)).dropDuplicates(["set_id", "signature", "base_points"])


def profile_top_matches(
    profiles: DataFrame,
    postings: DataFrame,
    posting_id: str,
    today: Column,
    remote_words: list[str],
    flag_words: list[str],
    k: int = settings.TOP_POSTINGS,
) -> DataFrame:
    """The ``k`` best postings of every profile ``(profile_id, skills)``.

    Only postings that share a skill are candidates. What a posting scores for any skill
    set depends on two things only: which of all skills it names, its signature, and its
    base points. So the first ``k`` ids of every (signature, base points) stand for all
    of its postings, and skill sets meet signatures, never postings. Profiles with the
    same skills share one skill set. Which signatures a set meets is up to
    ``candidate_pairs``.
    """
    skill_set = F.array_sort(F.array_distinct(F.transform("skills", lambda s: F.lower(s))))
    signed = profiles.select("profile_id", skill_set.alias("skill_set")).withColumn(
        "set_id", F.sha2(F.to_json("skill_set"), 256)
    )
    sets = signed.groupBy("set_id").agg(F.any_value("skill_set").alias("skill_set"))
    all_words = sets.select(F.explode("skill_set").alias("word")).distinct()
    described = postings.withColumn("words", F.array_distinct(words_of("title", "description")))
    featured = posting_points(described, today, remote_words, flag_words).select(
        posting_id, "base_points", "words"
    )
    named = (
        # The outer form: a plain explode would have the words computed twice, for a filter.
        featured.select(posting_id, "base_points", F.explode_outer("words").alias("word"))
        .join(all_words, "word", "left_semi")
        .groupBy(posting_id, "base_points")
        .agg(F.sort_array(F.collect_set("word")).alias("signature"))
    )
    first = top_per_group(named, ["signature", "base_points"], [F.col(posting_id)], k, "_nth")
    groups = materialize(first.groupBy("signature", "base_points").agg(F.collect_list(posting_id).alias("ids")))
    pairs = candidate_pairs(sets, groups, posting_id, k)
    scored = pairs.withColumn(
        "score", final_score(skill_points(F.col("n_shared"), F.size("skill_set")) + F.col("base_points"))
    )
    listed = scored.select("set_id", "n_shared", "score", F.explode("ids").alias(posting_id))
    best = top_per_group(listed, ["set_id"], [F.col("score").desc(), F.col(posting_id)], k, "place")
    return signed.select("profile_id", "set_id").join(
        best.select("set_id", posting_id, "n_shared", "score", "place"), "set_id"
    ).drop("set_id")
