import hashlib
import random

from pyspark.sql import functions as F

from postlane.llm import sketches


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_edited_texts_and_neighbours(documents):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices("abcdefghijklé", k=1)[0] * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 200))) for _ in range(60)]
    ids = sorted(rnd.sample(range(-50, 10_000), 60))
    rows = {r["doc_id"]: r for r in sketches.compare_with_edit(documents(*zip(ids, texts)).repartition(4)).collect()}
    errors = []
    for i, (number, text) in enumerate(zip(ids, texts)):
        following = texts[(i + 1) % len(texts)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = rows[number]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 100:
            errors.append(row["near_edited"] - len(a & b) / len(a | b))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert errors and abs(sum(errors) / len(errors)) < 0.05


def test_containment_of_a_part_in_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    part = " ".join(f"w{i}" for i in range(5000, 5800)) + " " + " ".join(f"x{i}" for i in range(200))
    df = spark.createDataFrame([(long, part)], "a string, b string")
    df = sketches.add_sketch(sketches.add_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    contained, alike = df.select(
        sketches.containment(F.col("sb"), F.col("sa")), sketches.likeness(F.col("sa"), F.col("sb"))
    ).first()
    assert abs(contained - 796 / 996) < 0.08 and alike < 0.05


def test_fingerprints_spell_sketches_that_merge(spark):
    texts = [" ".join(f"{c}{i % 37}" for i in range(n)) for c, n in zip("abcde", (0, 1, 4, 60, 300))]
    df = spark.createDataFrame([(t, u, f"{t} {u}") for t in texts for u in texts], "a string, b string, c string")
    for name in ("a", "b"):
        df = sketches.add_sketch(df, F.col(name), f"s{name}")
    merged = sketches.merge(F.col("sa"), F.col("sb"))
    for sa, back, m, ab in df.select(
        "sa", sketches.from_fingerprint(sketches.to_fingerprint(F.col("sa"))), merged, F.array_union("sa", "sb")
    ).collect():
        assert sa == sorted(set(sa)) == back
        low = sorted(h for h in ab if h < 2**29)
        assert m == (low or sorted(ab)[:1])


def test_odd_rows(documents, odd_rows):
    rows = sketches.compare_with_edit(documents(*odd_rows, clashing=True)).collect()
    assert len(rows) == len(odd_rows)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[4, 36] == by_text[5, 36]
    empty = [r for r in rows if r["doc_id"] == 2][0]
    assert empty["fingerprint"] == empty["edited_fingerprint"] == "" and empty["near_edited"] == 1.0
    assert sketches.compare_with_edit(documents()).count() == 0
    alone = sketches.compare_with_edit(documents((9, "one two three four"))).first()
    assert alone["near_next"] == 1.0


def test_containment_of_short_parts_is_right_or_unknown(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    whole = rnd.sample(words, 2000)
    rows = []
    for size in (5, 6, 8, 12, 40):
        for _ in range(60):
            at = rnd.randrange(2000 - size)
            rows.append((" ".join(whole[at : at + size]), " ".join(whole), 1))
            rows.append((" ".join(f"x{rnd.random()}" for _ in range(size)), " ".join(whole), 0))
    df = spark.createDataFrame(rows, "part string, whole string, inside int")
    df = sketches.add_sketch(sketches.add_sketch(df, F.col("part"), "p"), F.col("whole"), "w")
    got = df.select("inside", F.size(F.split("part", " ")).alias("size"), sketches.containment(F.col("p"), F.col("w")).alias("c")).collect()
    assert all(r["c"] is None or r["c"] == r["inside"] for r in got)
    # Parts of one shingle often have no hash below the threshold, longer ones hardly ever.
    assert sum(r["c"] is None for r in got if r["size"] == 40) <= 1
    assert 0 < sum(r["c"] is None for r in got if r["size"] == 5) < 120
    same = df.select(sketches.containment(F.col("p"), F.col("p")).alias("c")).distinct().collect()
    assert [r["c"] for r in same] == [1.0]
