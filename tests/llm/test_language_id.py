import random

import pytest

from postlane.llm import language_id

WORDS = {
    "aa": "the and of thing with under there other over water mother".split(),
    "bb": "kala muuta joka sanoa olla minun talossa metsään vettä äiti".split(),
    "cc": "être avec dans pour maison eau mère sous autre où là çela".split(),
}


def text_in(lang, n, rnd):
    return " ".join(rnd.choices(WORDS[lang], k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(documents):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        lang = rnd.choice(sorted(WORDS))
        rows.append((i, text_in(lang, rnd.randrange(8, 60), rnd), lang, "s", 0))
    return documents(*rows)


@pytest.fixture(scope="module")
def model(labelled):
    return language_id.fit(labelled.where(~language_id.held_out()))


def test_held_out_accuracy(labelled, model):
    judged = language_id.identify(labelled.where(language_id.held_out()), model).collect()
    assert len(judged) > 60
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.98
    assert all(0 <= r["score"] <= 1 for r in judged)
    assert sum(r["rejected"] for r in judged) <= 2


def test_the_sample_is_bounded_and_stable(labelled, model):
    assert model == language_id.fit(labelled.repartition(9).where(~language_id.held_out()))
    small = language_id.fit(labelled, sample_docs=3, dictionary_bytes=100)
    assert sorted(small) == sorted(WORDS) and all(0 < len(d) <= 100 for d in small.values())
    with pytest.raises(ValueError):
        language_id.fit(labelled, sample_docs=5, max_languages=2)


def test_languages_of_long_texts_count_to_their_end(model):
    rnd = random.Random(2)
    text = text_in("aa", 30, rnd) + " " + text_in("bb", 4000, rnd)
    assert language_id.classify(text, language_id.compressors(model))[0] == "bb"


def test_odd_rows(documents, odd_rows, model):
    df = documents(*odd_rows, clashing=True)
    out = language_id.identify(df, model)
    assert set(out.columns) == set(df.columns) | {"lang_pred", "rejected"}
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        no_letters = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == no_letters
        assert r["lang_pred"] in {"und", *WORDS} and 0 <= r["score"] <= 1
        assert not no_letters or (r["score"] == 0 and r["rejected"])


def test_nothing_to_learn_from(documents):
    docs = documents((1, "some text", None), (2, None, "en"))
    assert language_id.fit(docs) == {}
    rows = language_id.identify(docs, {}).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in rows} == {("und", 0.0, True)}
    assert language_id.identify(documents(), {}).count() == 0
    only = language_id.fit(documents((1, "some text", "en")))
    assert language_id.classify("text", language_id.compressors(only)) == ("en", 1.0)


def test_ties_go_to_the_first_language():
    same = language_id.compressors({"b": b"some words", "a": b"some words"})
    assert language_id.classify("other text", same) == ("a", 0.0)


def test_letters_are_unicode_letters():
    for text in ("½", "Ⅷ ²", "①②", "٣٤", "12 _ !", "\u0301 \u0301", ""):
        assert language_id.letters_only(text) == b"", text
    assert language_id.letters_only("Ⅷ Naïve½ don't_STOP 漢字") == "naïve don t stop 漢字".encode()
    # Marks belong to their letters.
    assert language_id.letters_only("हिन्दी ภาษาไทยที่") == "हिन्दी ภาษาไทยที่".encode()

