import collections
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from postlane.llm import simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] if len(words) >= width else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = {i: plain_print(t) for i, t in rows}
    found = roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    return {i: (f"{prints[i]:016x}", found[i]) for i in prints}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_are_exact(spark, documents, odd_rows):
    for text in ("", " \t ", "One", "one two", "a b c", "a b c a b c a b c", "É é x\x0by\x1fz  q\r\nw", "x" * 5000):
        assert simhash.fingerprint(text.encode()) == plain_print(text)
    # Spark's own hash of a text is the same function with the same seed.
    native = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", seed=42)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = plain_print(text)
    for piece, block in ((1, 1), (7, 3), (64, 1000)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"only two") == plain_print("only two")


def some_prints(rnd, flips):
    out = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(30):
            value = centre
            for _ in range(rnd.randrange(flips)):
                value ^= 1 << rnd.randrange(64)
            out.add(value)
    return out


@pytest.mark.parametrize("paired", [2, 16, 10_000])
def test_links_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    prints = some_prints(random.Random(paired), 7)
    df = spark.createDataFrame([(signed(p),) for p in prints], "_print bigint")
    edges = [tuple(v % (1 << 64) for v in r) for r in simhash.links(df).collect()]
    assert all((x ^ y).bit_count() in (1, 2) for x, y in edges)
    linked = {frozenset(e) for e in edges}
    expected = roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert roots(prints, lambda a, b: frozenset((a, b)) in linked) == expected
    if paired == 10_000:
        # Every pair is found, under one key of each half that differs by a bit at most.
        pairs = {frozenset(p) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 2}
        assert linked == pairs


def test_a_large_group_needs_no_pairs(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 1500:
        value = centre
        for _ in range(rnd.randrange(1, 5)):
            value ^= 1 << rnd.randrange(64)
        prints.add(value)
    df = spark.createDataFrame([(signed(p),) for p in prints], "_print bigint")
    edges = simhash.links(df).collect()
    assert len(edges) <= 65 * len(prints)
    linked = collections.defaultdict(set)
    for x, y in edges:
        linked[x].add(y)
        linked[y].add(x)
    seen, todo = set(), [signed(centre)]
    while todo:
        if (node := todo.pop()) not in seen:
            seen.add(node)
            todo.extend(linked[node])
    expected = roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(seen) == sum(r == expected[centre] for r in expected.values())


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    keep, plans = simhash.stored, {}

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(simhash, "stored", planned)
    monkeypatch.setattr(simhash, "PAIRED", 2)
    df = spark.createDataFrame([(signed(p),) for p in some_prints(random.Random(3), 4)], "_print bigint")
    edges = simhash.links(df)
    plans["edges, as begun"] = edges._jdf.queryExecution().executedPlan().toString()
    assert edges.collect()
    plans["edges, as run"] = edges._jdf.queryExecution().executedPlan().toString()
    # The threshold is Spark's own: such small tables would all be broadcast.
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert not {name for name, plan in plans.items() if "Broadcast" in plan}
    assert all(plan.count("SortMergeJoin") >= (1 if name == "members" else 2) for name, plan in plans.items())


def test_groups_equal_brute_force(documents):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = ["", "  ", "One", "one", "a b", "a b c", "a b c d"]
    for _ in range(15):
        words = rnd.choices(vocabulary, k=rnd.randrange(1, 150))
        for _ in range(rnd.randrange(1, 12)):
            if rnd.random() < 0.8:
                words = list(words)
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words).title() if rnd.random() < 0.2 else " ".join(words))
    rnd.shuffle(rows)
    numbered = list(enumerate(rows))
    got = simhash.near_duplicate_prints(documents(*numbered)).collect()
    expected = brute(numbered)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 10


def test_odd_rows(documents, odd_rows):
    out = simhash.near_duplicate_prints(documents(*odd_rows, clashing=True))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(odd_rows)
    zero = "0" * 16
    counts = collections.Counter(rows)
    assert counts[(None, zero, 1)] == 1 and counts[(3, zero, 1)] == 1
    same = f"{plain_print(odd_rows[5][1]):016x}"
    assert counts[(4, same, 4)] == 2 and counts[(5, same, 4)] == 1
    texts = collections.Counter((r[0], f"{plain_print(r[1]):016x}") for r in odd_rows)
    assert collections.Counter((r[0], r[1]) for r in rows) == texts
    assert simhash.near_duplicate_prints(documents()).count() == 0


def test_groups_without_ids(documents):
    out = simhash.near_duplicate_prints(documents((None, "a b c"), (None, "A b c"), (None, "x y z"), (7, "x y z")))
    rows = [tuple(r) for r in out.collect()]
    assert sorted(r[2] is None for r in rows) == [False, False, True, True]
    assert {r[2] for r in rows if r[0] == 7} == {7}
