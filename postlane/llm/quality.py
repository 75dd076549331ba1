"""Quality rules whose cutoffs are chosen with a bound on false rejections.

Each rule rejects a document whose metric is above a cutoff. The cutoffs on offer are
fixed before any data is seen. One level of strictness moves the cutoffs of all rules
together, so what a level rejects, every stricter level rejects too. Labelled documents
serve as the holdout: for every stratum and level the good documents that any rule would
reject are counted, and the exact binomial test asks whether it refutes "more than
``max_false_rejection`` of the good documents are rejected" at level ``error / strata``.
Levels are tested in fixed sequence, from lax to strict, up to the first that is not
refuted; so no further correction is needed. The strictest level passed is used, none if
the first fails. With probability ``1 - error``, then, in no stratum more than
``max_false_rejection`` of the good documents are rejected by all rules together, however
the strata differ.

Metrics are computed once per document by column functions and stored as narrow rows; the
holdout costs one aggregation with partial counts.

Defined results: a null or empty text has zeros everywhere and fails the base rules; a
null stratum is a stratum of its own; labels that contradict each other for one id count
as bad; unlabelled strata get no cutoff, so all their documents that pass the base are
kept; repeated rows are judged alike and count once as labelled documents. Extra input columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import SPACES, computed, shingle_hashes, stored, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Rule: metric over the base columns, and the cutoffs on offer, strictest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "repeat_share": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "dup_lines_per_word": ("n_dup_lines / n_words", (0.005, 0.01, 0.02, 0.04, 0.08, 0.16)),
    "long_words": ("word_chars / n_words", (6.5, 7.5, 8.5, 9.5, 11.0, 14.0)),
    "short_words": ("- word_chars / n_words", (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5)),
}
MAX_FALSE_REJECTION = 0.02
ERROR = 0.05
# Strata are languages; their cutoffs are broadcast, so their number has a bound.
MAX_STRATA = 1000


def base_columns(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, ``_stratum``, ``_text_hash``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_of(docs)
    real_lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    df = docs.select(
        "doc_id",
        F.coalesce(F.col(stratum).cast("string"), F.lit("null")).alias("_stratum"),
        text.alias("_text"),
        F.xxhash64(text).alias("_text_hash"),
    )
    df = computed(df, "_words", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    df = df.select(
        "doc_id",
        "_stratum",
        "_text_hash",
        F.size("_words").alias("_n"),
        F.length(F.translate("_text", SPACES, "")).alias("_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("_symbols"),
        real_lines.alias("_lines"),
        shingle_hashes(F.col("_words"), WINDOW_WORDS).alias("_windows"),
    )
    df = computed(
        df.select("doc_id", "_stratum", "_text_hash", "_n", "_chars", "_symbols", "_windows",
                  (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup")),
        "_sorted",
        # Only texts in which some window comes back are sorted.
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    window = lambda i: F.get(F.col("_sorted"), i)["h"]
    repeated = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(x["h"] == window(i - 1), F.lit(False)) | F.coalesce(x["h"] == window(i + 1), F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, at: F.struct(
            (at + WINDOW_WORDS).alias("end"), (s["n"] + at + WINDOW_WORDS - F.greatest(s["end"], at)).alias("n")
        ),
        lambda s: s["n"],
    )
    whole = lambda c: c.cast("bigint")
    return df.select(
        "doc_id",
        "_stratum",
        "_text_hash",
        whole(F.col("_n")).alias("n_words"),
        whole(F.col("_chars")).alias("word_chars"),
        whole(F.col("_symbols")).alias("n_symbols"),
        whole(F.col("_dup")).alias("n_dup_lines"),
        whole(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def metric(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(RULES[rule][0]))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), for k up to its mean; 1 beyond, where nothing is refuted."""
    odds = (1 - p) / p
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    log_ways = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))
    log_term = log_ways + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    # Sum of all terms up to the k-th, in units of the k-th.
    terms = F.aggregate(steps, F.lit(1.0), lambda s, i: 1.0 + s * i / (n - i + 1) * odds)
    return F.when((n > 0) & (k <= n * p), F.exp(log_term) * terms).otherwise(1.0)


def admitted_cutoffs(
    base: DataFrame, labels: DataFrame, max_false_rejection: float, error: float
) -> DataFrame:
    """Per stratum an array with the cutoff of each rule, nulls where no level is admitted."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    # A document that is stored several times is one piece of evidence.
    labelled = base.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    held = labelled.dropDuplicates(["_stratum", "doc_id", "_text_hash"])
    levels = range(min(len(cutoffs) for _, cutoffs in RULES.values()))

    def rejected(level: int) -> Column:
        return reduce(or_, [metric(rule) > cutoffs[level] for rule, (_, cutoffs) in RULES.items()])

    counts = held.groupBy("_stratum").agg(
        F.count(F.lit(1)).alias("_good"), *[F.count_if(rejected(c)).alias(f"_level_{c}") for c in levels]
    )
    # Strata are few by contract, so one row can hold them all to count them.
    each = F.lit(error) / F.size("_each")
    every = counts.agg(F.collect_list(F.struct("*")).alias("_each")).select(each.alias("_error"), F.inline("_each"))
    passed = [
        binomial_tail(F.col("_good"), F.col(f"_level_{c}"), max_false_rejection) <= F.col("_error") for c in levels
    ]
    # Levels are listed from strict to lax: one counts only if all laxer ones passed as well.
    level = F.coalesce(*[F.when(reduce(and_, passed[c:]), F.lit(c)) for c in levels])
    chosen = [F.get(F.array(*map(F.lit, cutoffs)), level) for _, cutoffs in RULES.values()]
    return every.select("_stratum", F.array(*chosen).alias("_cutoffs"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    max_false_rejection: float = MAX_FALSE_REJECTION,
    error: float = ERROR,
    max_strata: int = MAX_STRATA,
) -> DataFrame:
    """Base columns of every document, ``kept``, and the names of the rules that reject it."""
    base = stored(base_columns(docs, stratum), "quality")
    cutoffs = stored(admitted_cutoffs(base, labels, max_false_rejection, error), "cutoffs")
    if cutoffs.count() > max_strata:
        raise ValueError(f"more than {max_strata} strata: their cutoffs are broadcast")
    broken = F.array_compact(
        F.array(
            *[
                F.when(metric(rule) > F.get(F.col("_cutoffs"), F.lit(i)), F.lit(rule))
                for i, rule in enumerate(RULES)
            ]
        )
    )
    return (
        base.join(F.broadcast(cutoffs), "_stratum", "left")
        .withColumn("broken_rules", F.array_join(broken, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "broken_rules",
        )
    )
