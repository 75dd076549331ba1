import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators add or use inside, as columns of the input.
CLASHES = ["score", "kept", "copy_no", "n_removed", "spans", "ids", "_id", "_text", "_n", "_set", "n_words", "a.b"]


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, lang, source, n_chars]) rows."""

    def make(*rows, clashing=False):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES])
        return df

    return make


LONG = "word after word and so on until the end of it \n" * 6000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    return [
        (None, "a text without an id", "en", "s1", 20),
        (None, None, None, None, None),
        (1, None, "en", "s1", 0),
        (2, "", "en", None, 0),
        (3, " \t\n\x0b\x0c\r ", None, "s2", 7),
        (4, "The same words stand here twice over", "en", "s1", 36),
        (4, "The same words stand here twice over", "en", "s1", 36),
        (4, "Other words under the same number", "en", "s3", 33),
        (5, "The same words stand here twice over", "fr", "s2", 36),
        (6, LONG, "en", "s1", len(LONG)),
        (7, "é😀\x00▁ ß ¼ 漢字", None, "s1", None),
        (8, "12345 !!! 67", "xx", "s1", 12),
    ]
