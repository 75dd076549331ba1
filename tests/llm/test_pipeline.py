import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry_points
import corpus_pipeline
from postlane.llm import queries
from tests.llm.test_near_dup import brute as near_groups
from tests.llm.test_near_dup import shingles


@pytest.fixture(scope="module")
def raw(documents):
    rnd = random.Random(1)
    words = {
        "en": "the and of thing with under there other over water mother".split(),
        "xx": "kala muuta joka sanoa olla minun talossa metsään vettä äiti".split(),
    }
    rows = []
    for i in range(150):
        lang = rnd.choice(["en", "xx"])
        lines = [" ".join(rnd.choices(words[lang], k=12)) + f" {i}{j}" for j in range(rnd.randrange(2, 6))]
        lines.insert(1, "the same menu on every page of it")
        rows.append((i, "\n".join(lines), lang if i % 4 else None, f"src{i % 12}", 0))
    rows += [(200 + i, rows[3][1], rows[3][2], f"src{i}", 0) for i in range(5)]
    rows += [(300, None, "en", "src1", 0), (301, "12 34", "en", "src1", 0), (302, "", None, None, None)]
    return rows, documents(*rows)


def test_every_stage_against_its_rule(spark, raw):
    rows, docs = raw
    names = docs.columns
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        results.append(docs.collect())
        if len(results) < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    languages, lines, groups, mixed, encoded = results

    assert {r["doc_id"] for r in languages} == {r[0] for r in rows if r[0] < 300}
    assert all(r["lang"] in ("en", "xx") for r in languages)

    menu = "the same menu on every page of it"
    assert sum(menu in r["text"].split("\n") for r in lines) == 1
    assert {r["doc_id"] for r in lines} == {r["doc_id"] for r in languages}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    expected = near_groups([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in groups} == {i for i, (_, _, kept) in expected.items() if kept}
    assert not {200, 201, 202, 203, 204} & {r["doc_id"] for r in groups}

    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in groups}
    assert 0.6 * len(groups) < len(mixed) < 1.4 * len(groups)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert sorted(r["doc_id"] for r in encoded) == sorted(r["doc_id"] for r in mixed)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True) for r in encoded)


def five_word_groups(rows):
    """Ids that stay when pairs with four fifths of their five-word shingles in common are linked."""
    sets = {i: shingles(t, 5) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark, documents):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(60):
        words = rnd.choices(vocabulary, k=rnd.randrange(60, 160))
        rows.append((len(rows), " ".join(words)))
        # One contiguous change: above the threshold on five words and below 85 percent on
        # three, or the other way round with changes that are spread.
        at, n = rnd.randrange(5, 30), round(len(words) * rnd.uniform(0.02, 0.12))
        rows.append((len(rows), " ".join([*words[:at], *(f"x{len(rows)}y{k}" for k in range(n)), *words[at + n :]])))
        edited = list(words)
        for k in range(0, len(words) - 10, 40):
            edited[k + rnd.randrange(5, 10)] = f"z{len(rows)}k{k}"
        rows.append((len(rows), " ".join(edited)))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(*rows), "").collect()}
    expected = five_word_groups(rows)
    by_three = {i for i, (_, _, stays) in near_groups(rows).items() if stays}
    assert expected - by_three and by_three - expected
    assert kept == expected


def test_one_row_of_each_group_stays(spark, documents):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    a, b, c, d, e, f = (" ".join(rnd.choices(vocabulary, k=60)) for _ in range(6))
    groups = [
        [(1, a, "en", "s2", 5), (1, a, "en", "s1", 5), (1, a, "en", "s1", 5)],  # repeated rows
        [(None, b, "en", "s1", 5), (None, b, "en", "s1", 5), (None, b + " x", "en", "s1", 5)],
        [(None, c, "en", "s1", 5), (9, c, "en", "s1", 5), (7, c + " y", None, None, None)],
        [(3, d, "en", "s1", 5), (2, d, "en", "s1", 5), (2, d + " z", "en", "s1", 5)],  # one id, two texts
        [(3, e, "en", "s1", 5)],  # the id of a row that goes
        [(None, f, "en", "s1", 5)],
        [(None, None, "en", "s1", 5)],
        [(None, " ", "en", "s1", 5), (None, " ", "en", "s1", 5)],
    ]
    rows = [r for group in groups for r in group]
    results = []
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.drop_near_duplicates(spark, documents(*order), "")
        results.append([tuple(r) for r in out.collect()])
    assert sorted(results[0], key=str) == sorted(results[1], key=str)
    for group in groups:
        assert sum(results[0].count(r) for r in set(group)) == 1
    assert len(results[0]) == len(groups)
    assert (1, a, "en", "s1", 5) in results[0] and (7, c + " y", None, None, None) in results[0]


def test_run_over_an_empty_table(spark, documents, tmp_path):
    documents().write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = entry_points.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        duck.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = duck.execute(queries.ORACLE[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted(str([row[i] for i in places]) for row in cursor.fetchall())
    assert sorted(str([row[c] for c in columns]) for row in frame.collect()) == expected
    assert expected


def test_languages_are_found_once_per_text(spark, raw):
    """A filter on the verdict must not bring a second pass, with workers of its own, along."""
    kept = corpus_pipeline.identify_language(spark, raw[1], "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
