"""Preference formatting: one prompt and two masked completions per pair of conversations.

The turns that a chosen and a rejected conversation share from the start are rendered once
as the prompt. What remains of each is a completion, with a mask that lists the stretches
of code points to train on: the words of the assistant's turns and the mark that ends them.
All is done by column functions on the arrays of a pair; a conversation's turns are the only
thing that is gathered, and a conversation is the unit that is rendered.

Turns are equal if role and text are (nulls equal nulls). The opening mark inside a text is
broken by a space, so that no text can pose as another turn. Defined results: a null role or
text renders as nothing between the marks; pairs without a difference have the whole as their
prompt, empty completions and empty masks; turns with equal numbers are ordered by role and
text; repeated rows are repeated turns; a null conversation id is one conversation; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import hash52, others
from postlane.operators.ordering import global_position

# The marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit(""))


def _words(turn: Column) -> Column:
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def render(turns: Column) -> Column:
    """All turns of an array, one after the other."""
    shown = F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), _role(t), F.lit("\n"), _words(t), F.lit(CLOSE + "\n"))
    )
    return F.array_join(shown, "")


def trained_spans(turns: Column) -> Column:
    """``start:end`` of every stretch to train on in the rendered turns, joined by commas."""

    def step(state, turn):
        start = state["at"] + len(OPEN) + F.length(_role(turn)) + 1
        end = start + F.length(_words(turn)) + len(CLOSE)
        span = F.when(_role(turn) == TRAINED_ROLE, F.array(F.concat(start.cast("string"), F.lit(":"), end.cast("string"))))
        return F.struct(
            (end + 1).alias("at"), F.concat(state["spans"], F.coalesce(span, F.array().cast("array<string>"))).alias("spans")
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["spans"]), ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    equal = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    unequal_at = F.array_position(equal, False)
    return F.when(unequal_at == 0, F.size(chosen)).otherwise(unequal_at - 1).cast("int")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Replaces ``chosen`` and ``rejected`` (arrays of turns) by prompt, completions and masks.

    Other columns stay, apart from those named like the results.
    """
    made = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    rest = others(pairs, *made)
    turns = lambda c: F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType))
    after = lambda c: F.slice(turns(c), F.col("__shared") + 1, F.greatest(F.size(turns(c)) - F.col("__shared"), F.lit(0)))
    split = pairs.withColumn("__shared", common_turns(turns("chosen"), turns("rejected")))
    return split.select(
        *rest,
        F.col("__shared").cast("bigint").alias("n_prompt_turns"),
        render(F.slice(turns("chosen"), F.lit(1), F.col("__shared"))).alias("prompt"),
        render(after("chosen")).alias("chosen"),
        render(after("rejected")).alias("rejected"),
        trained_spans(after("chosen")).alias("chosen_mask"),
        trained_spans(after("rejected")).alias("rejected_mask"),
    )


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the last answer against that of the next conversation.

    ``chosen`` is a conversation up to its last assistant turn. ``rejected`` has, in place
    of this turn, the last assistant turn of the next conversation by id that has one (after
    the last the first): an answer to something else. Neighbours are found on ids alone.
    """
    turn = F.struct("turn", "role", "text")
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    numbered = F.transform("_turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role")))
    last = F.array_max(F.transform(F.filter(numbered, lambda t: t["role"] == TRAINED_ROLE), lambda t: t["i"]))
    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    answered = (
        gathered.withColumn("_last", last)
        .where("_last is not null")
        .select(
            "conv_id",
            F.slice(plain, F.lit(1), F.col("_last")).alias("_before"),
            F.element_at(plain, F.col("_last") + 1).alias("_answer"),
        )
    )
    ids = conversations.where(F.col("role") == TRAINED_ROLE).select(F.col("conv_id").alias("_id")).distinct()
    placed = global_position(ids, ["_id"], "_at")
    total = max(placed.count(), 1)
    following = placed.select(F.col("_id").alias("rejected_conv"), ((F.col("_at") + total - 1) % total).alias("_at"))
    neighbours = placed.join(following, "_at").select("_id", "rejected_conv")
    others = answered.select(F.col("conv_id").alias("_other"), F.col("_answer").alias("_other_answer"))
    return (
        answered.join(neighbours, answered["conv_id"].eqNullSafe(neighbours["_id"]))
        .join(others, F.col("rejected_conv").eqNullSafe(F.col("_other")))
        .select(
            "conv_id",
            "rejected_conv",
            F.concat("_before", F.array("_answer")).alias("chosen"),
            F.concat("_before", F.array("_other_answer")).alias("rejected"),
        )
    )


def branch_pairs(conversations: DataFrame, seed: int = 7) -> DataFrame:
    """Pairs from plain conversations that part ways at an answer.

    ``chosen`` is a whole conversation. ``rejected`` follows it up to one of its answers, picked
    by a hash of the id, and goes on as the next conversation by id does from that turn on
    (after the last the first): any number of turns, and equal ones for as long as the two
    agree. A conversation without an answer is followed to its end. Every conversation gives
    a pair. Neighbours are found on ids alone.
    """
    turn = F.struct("turn", "role", "text")
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    numbered = F.transform("_turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role")))
    answers = F.transform(F.filter(numbered, lambda t: t["role"] == TRAINED_ROLE), lambda t: t["i"])
    picked = F.get("_answers", (hash52(seed, "conv_id") % F.size("_answers")).cast("int"))
    whole = gathered.select("conv_id", plain.alias("_own"), answers.alias("_answers")).select(
        "conv_id", "_own", F.when(F.size("_answers") > 0, picked).otherwise(F.size("_own")).alias("_branch")
    )
    placed = global_position(conversations.select(F.col("conv_id").alias("_id")).distinct(), ["_id"], "_at")
    total = max(placed.count(), 1)
    following = placed.select(F.col("_id").alias("rejected_conv"), ((F.col("_at") + total - 1) % total).alias("_at"))
    neighbours = placed.join(following, "_at").select("_id", "rejected_conv")
    later = whole.select(F.col("conv_id").alias("_other"), F.col("_own").alias("_others"))
    goes_on = F.slice("_others", F.col("_branch") + 1, F.greatest(F.size("_others") - F.col("_branch"), F.lit(0)))
    return (
        whole.join(neighbours, whole["conv_id"].eqNullSafe(neighbours["_id"]))
        .join(later, F.col("rejected_conv").eqNullSafe(F.col("_other")))
        .select(
            "conv_id",
            "rejected_conv",
            F.col("_own").alias("chosen"),
            F.concat(F.slice("_own", F.lit(1), F.col("_branch")), goes_on).alias("rejected"),
        )
    )
