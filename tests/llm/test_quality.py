import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postlane.llm import quality


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    figures = (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )
    return (*figures, figures[0] < 20 or 100 * figures[4] > 30 * figures[0])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
NO_LABELS = "doc_id bigint, quality int"


def test_base_columns_equal_brute_force(spark, documents):
    rnd = random.Random(1)
    texts = ["", None, " \t\x0b\x0c\r\n", "a", "a " * 30, "é😀 ## x y z\x1fq " * 4]
    for _ in range(150):
        vocabulary = [rnd.choice(["ab", "é", "#x", "c|", "漢", "\x1f", " "]) for _ in range(rnd.randrange(1, 8))]
        texts.append("".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "\t", " \n", "\r", "\x0b"]) for _ in range(rnd.randrange(0, 90))))
    base = quality.judge(documents(*[(i, t, "en") for i, t in enumerate(texts)]), spark.createDataFrame([], NO_LABELS))
    rows = {r["doc_id"]: r for r in base.collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i][c] for c in BASE) == brute_base(text)
        assert rows[i]["kept"] == (not rows[i]["base_failed"])  # no labels, no cutoffs


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 100, 2500) for k in (0, 1, 3, 20, 90)]
    for p in (0.004, 0.2):
        rows = spark.createDataFrame(cases, "n bigint, k bigint").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), p)).collect()
        for n, k, tail in rows:
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1)) if k <= n * p else 1.0
            assert tail == pytest.approx(exact, rel=1e-9)


def labelled(spark, documents, n, bad_share, strange_good=0):
    rnd = random.Random(2)
    rows, labels = [], []
    words = [f"w{i:03}" for i in range(500)]
    for i in range(n):
        bad = rnd.random() < bad_share
        mark = "##" if bad or i < strange_good else ""
        rows.append((i, " ".join(w + mark for w in rnd.sample(words, 30)), "en" if i % 2 else "fr"))
        labels.append((i, int(not bad)))
    return documents(*rows), spark.createDataFrame(labels, NO_LABELS)


def test_bad_documents_go_and_good_ones_stay(spark, documents):
    docs, labels = labelled(spark, documents, 6000, 0.1)
    out = quality.judge(docs, labels).join(labels, "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) == 0
    assert {r[0] for r in out.where("quality = 0").select("broken_rules").distinct().collect()} == {"symbols_per_word"}


def test_a_cutoff_that_hurts_one_stratum_is_not_used_there(spark, documents):
    docs, labels = labelled(spark, documents, 6000, 0.1)
    # In one language the sign is normal.
    docs = docs.withColumn("text", F.when(F.col("lang") == "fr", F.translate("text", "w", "#")).otherwise(F.col("text")))
    out = quality.judge(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    good = {r["lang"]: r["kept"] for r in out.where("quality = 1").groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    bad = {r["lang"]: r["kept"] for r in out.where("quality = 0").groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert good == {"en": 1.0, "fr": 1.0} and bad["en"] == 0.0


def test_few_labels_admit_no_cutoff(spark, documents):
    docs, labels = labelled(spark, documents, 200, 0.3)
    assert quality.judge(docs, labels).where("not kept").count() == 0


def test_a_few_hundred_labels_admit_cutoffs(spark, documents):
    docs, labels = labelled(spark, documents, 500, 0.1)
    out = quality.judge(docs, labels).join(labels, "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert counts[(0, False)] == labels.where("quality = 0").count()
    assert counts[(1, True)] == labels.where("quality = 1").count()


def test_a_document_stored_many_times_is_one_piece_of_evidence(spark, documents):
    words = [f"w{i}" for i in range(500)]
    rnd = random.Random(3)
    good, marked = (" ".join(w + mark for w in rnd.sample(words, 30)) for mark in ("", "##"))
    labels = spark.createDataFrame([(1, 1)], NO_LABELS)
    docs = documents(*[(1, good, "en")] * 300, (2, marked, "en"))
    assert quality.judge(docs, labels).where("not kept").count() == 0
    many = [(i, " ".join(rnd.sample(words, 30)), "en") for i in range(10, 310)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in many], NO_LABELS)
    assert [r["doc_id"] for r in quality.judge(documents(*many, (2, marked, "en")), labels).where("not kept").collect()] == [2]


def test_levels_stop_where_good_documents_would_go(spark, documents):
    # Good documents with one sign per word: the level of 0.8 and all stricter ones fail.
    docs, labels = labelled(spark, documents, 1000, 0.0)
    docs = docs.withColumn("text", F.translate("text", "w", "#")).withColumn("lang", F.lit("en"))
    base = quality.base_columns(docs, "lang")
    (row,) = quality.admitted_cutoffs(base, labels, 0.02, 0.05).collect()
    assert row["_cutoffs"] == [cutoffs[5] for _, cutoffs in quality.RULES.values()]


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (99, None)], NO_LABELS)
    rows = quality.judge(documents(*odd_rows, clashing=True), labels).collect()
    assert len(rows) == len(odd_rows)
    expected = sorted(str((r[0], *brute_base(r[1]))) for r in odd_rows)
    assert sorted(str((r["doc_id"], *[r[c] for c in BASE])) for r in rows) == expected
    assert quality.judge(documents(), labels).count() == 0
    with pytest.raises(ValueError):
        docs, labels = labelled(spark, documents, 60, 0.1)
        quality.judge(docs, labels, max_strata=1)
