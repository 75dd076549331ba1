import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from postlane.llm import near_dup
from postlane.llm.rolling import SpanHasher

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_shingle_sets_are_exact():
    hasher = SpanHasher()
    for text in ("", " \t ", "One", "one two", "a b c a b c a b c", "É é x\x0by\x1fz  q\r\nw", "x" * 5000):
        assert len(near_dup.shingle_set(text.encode(), hasher, 3)) == len(shingles(text))
    same = [near_dup.shingle_set(t.encode(), hasher, 3) for t in ("A b  c D", "a\tB c\nd")]
    assert np.array_equal(*same)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{i % 997}" for i in range(5000)).encode()
    whole = near_dup.word_hashes(text, SpanHasher())
    monkeypatch.setattr(near_dup, "PIECE", 64)
    assert np.array_equal(whole, near_dup.word_hashes(text, SpanHasher()))


def test_signature_estimates_likeness():
    numbers = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = numbers[:2000], numbers[400:2400]
    agree = np.mean(near_dup.circulant_signature(a, 500) == near_dup.circulant_signature(b, 500))
    assert abs(agree - 1600 / 2400) < 0.07


def test_groups_equal_brute_force(documents):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randrange(1, 120))
        for _ in range(rnd.randrange(1, 9)):
            # Chains: each copy is edited from the one before.
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                words = words + rnd.choices(vocabulary, k=3)
            rows.append(" ".join(words))
    rnd.shuffle(rows)
    numbered = [(i, t) for i, t in enumerate([*rows, "", "   ", "Two words", "two WORDS"])]
    assert found(near_dup.near_duplicate_groups(documents(*numbered))) == brute(numbered)


def test_a_large_group_of_near_copies(documents):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    expected = brute(rows)
    assert len({c for _, c, _ in expected.values()}) < 20
    assert found(near_dup.near_duplicate_groups(documents(*rows))) == expected


def test_near_copies_below_the_threshold_are_not_listed_as_pairs(documents, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rnd.sample(range(120), 2):
            words[at] = f"x{i} {at}"
        rows.append((i, " ".join(words)))
    listed, confirmed = [], near_dup.confirmed

    def counted(pairs, *more):
        listed.append(pairs.count())
        return confirmed(pairs, *more)

    monkeypatch.setattr(near_dup, "confirmed", counted)
    expected = brute(rows)
    sets = [shingles(t) for _, t in rows]
    close = sum(100 * len(a & b) >= 78 * len(a | b) for a, b in itertools.combinations(sets, 2))
    linked = sum(100 * len(a & b) >= 85 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert found(near_dup.near_duplicate_groups(documents(*rows))) == expected
    assert sum(listed) <= linked + 100 < close / 2


def test_parities_bound_what_is_not_shared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, other in ((100, 10), (300, 60), (3000, 500), (5, 1)):
        numbers = np.unique(rng.integers(0, 1 << 64, n + other, dtype=np.uint64))
        a, b = numbers[:n], numbers[other:]
        odd = [near_dup.packed_parities(x).tolist() for x in (a, b)]
        differing = sum((x ^ y).bit_count() for x, y in zip(*[[v % (1 << 64) for v in o] for o in odd]))
        assert differing <= 2 * other and (n > 300 or differing >= 0.8 * 2 * other)
        both = len(np.intersect1d(a, b))
        rows.append((len(a), odd[0], len(b), odd[1], 100 * both >= 85 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "na long, a array<long>, nb long, b array<long>, linked boolean")
    agree = near_dup.may_agree(F.col("na"), F.col("a"), F.col("nb"), F.col("b"), 85)
    assert df.where(F.col("linked") & ~agree).count() == 0
    assert df.where("not linked").where(~agree).count() > 0


def test_rows_that_no_class_wants_are_left_out_of_the_shuffle(spark):
    rows = spark.range(10_000).selectExpr("nullif(id, 7) as id", "id * 3 as tag", "cast(id as string) as text")
    wanted = rows.where("id % 100 = 0 or id is null").select("id", "tag")
    left = near_dup.probably_in(rows, wanted, "id", "tag")
    assert left.columns == rows.columns
    assert left.join(wanted, left["id"].eqNullSafe(wanted["id"])).count() == wanted.count() == 101
    assert left.count() < 200
    assert near_dup.probably_in(rows, wanted.where("id < 0"), "id", "tag").count() == 0


def test_odd_rows(documents, odd_rows):
    out = near_dup.near_duplicate_groups(documents(*odd_rows, clashing=True))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [tuple(r) for r in out.collect()]
    counts = collections.Counter(rows)
    assert len(rows) == len(odd_rows)
    assert counts[(None, 0, None, True)] == 1  # null id and text
    assert counts[(1, 0, 1, True)] == counts[(2, 0, 2, True)] == counts[(3, 0, 3, True)] == 1
    assert counts[(4, 5, 4, True)] == 2 and counts[(4, 4, 4, True)] == 1
    assert counts[(5, 5, 4, False)] == 1
    assert near_dup.near_duplicate_groups(documents()).count() == 0


def test_packed_sketches_tell_likeness(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], []
    for shared in (100, 150, 170, 185, 195, 200):
        numbers = rng.integers(0, 1 << 63, 400 - shared, dtype=np.uint64)
        signatures = [near_dup.circulant_signature(s, 256) for s in (numbers[:200], numbers[200 - shared :])]
        rows.append([near_dup.packed_sketch(s).tolist() for s in signatures])
        agree = int((signatures[0] % 16 == signatures[1] % 16).sum())
        share = 0.85 + 0.15 / 16
        expected.append(agree >= 256 * share - 5 * (256 * share * (1 - share)) ** 0.5)
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(near_dup.may_be_alike(df["a"], df["b"], 85)).collect()]
    assert got == expected and got[-2:] == [True, True] and got[0] is False


def test_many_copies_edited_too_much_to_be_linked(documents):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randrange(0, 11)):
            if rnd.random() < 0.5:
                words.pop(rnd.randrange(len(words)))
            else:
                words[rnd.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert found(near_dup.near_duplicate_groups(documents(*rows))) == brute(rows)


def test_near_copies_without_an_id(documents):
    rnd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        words = rnd.choices(vocabulary, k=rnd.randrange(40, 90))
        for i in range(5):
            words = [*words[:-1], f"x{i}"] if i else words
            # Groups without any id, with one, and with ids alone; later rows are exact copies.
            rows.append((100 * g + i if g % 3 == 2 or (g % 3 == 1 and i == 3) else None, " ".join(words)))
        rows.append(rows[-5])
    # Brute force on places in the order of ids, nulls last.
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    places = brute([(place, rows[n][1]) for place, n in enumerate(order)])
    expected = []
    for place, n in enumerate(order):
        size, component, _ = places[place]
        first = rows[order[component]][0]
        expected.append((rows[n][0], size, first, rows[n][0] == first))
    got = [tuple(r) for r in near_dup.near_duplicate_groups(documents(*rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert sum(kept for i, _, _, kept in got if i is None) < sum(i is None for i, *_ in got)
