"""Language identification by compression.

One raw-content zstandard dictionary per language is cut from a bounded, hash-chosen
sample of labelled documents. A text is encoded with every dictionary, and the language
whose dictionary gives the fewest bytes wins. If the runner-up is nearly as short, the
text is rejected. The dictionaries (``dictionary_bytes`` each, ``max_languages`` at most)
are the whole model, so it is broadcast; texts never leave their partition.

Texts are lower-cased and everything but letters and their combining marks (Unicode
categories L and M) becomes one space, so that figures and punctuation, equal in all
languages, do not blur the difference. A text is encoded in blocks: a block never borrows
from earlier text, so the dictionaries matter as much at the end of a very long text as at
its start. A text of a few words has no matches that would shorten it, so its languages
often tie, and it is rejected.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected;
ties go to the alphabetically first language, with score 0; with no labelled language at
all every text is ``und``; repeated rows get equal results. Input columns named like the
added ones (``lang_pred``, ``score``, ``rejected``) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import hash52, others
from postlane.operators.ordering import top_per_group

UNKNOWN = "und"
# The first is the second for texts of ASCII alone, and faster.
NOT_ASCII_LETTERS = re.compile(r"[^a-z]+")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")

# The model's bounds: documents sampled per language, code points read of each, bytes kept.
SAMPLE_DOCS = 40
SAMPLE_CHARS = 2048
DICTIONARY_BYTES = 48 * 1024
MAX_LANGUAGES = 100
BLOCK_BYTES = 2048
# Relative lead of the shortest encoding over the next below which a text is rejected.
MIN_MARGIN = 0.004


def letters_only(text: str) -> bytes:
    """The lower-case letters of a text, its words apart; nothing if it has no letter."""
    lower = text.lower()
    kept = (NOT_ASCII_LETTERS if lower.isascii() else NOT_LETTERS).sub(" ", lower).strip()
    return kept.encode("utf-8", "replace") if any(map(str.isalpha, kept)) else b""


def fit(
    train: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    max_languages: int = MAX_LANGUAGES,
) -> dict[str, bytes]:
    """A raw dictionary per language from rows with ``doc_id``, ``text`` and ``lang``.

    Per language the ``sample_docs`` documents with the smallest hashes are taken, the
    first ``SAMPLE_CHARS`` code points of each: a bounded sample that does not depend on
    the order or the partitioning of the rows. No task ranks a whole language.
    """
    labelled = train.where("lang is not null and text is not null").select(
        "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), hash52(3, "doc_id").alias("_order")
    )
    rows = (
        top_per_group(labelled, ["lang"], [F.col("_order"), F.col("text")], sample_docs, "_rank")
        .limit(sample_docs * max_languages + 1)
        .collect()
    )
    if len(rows) > sample_docs * max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    sampled: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["_rank"])):
        sampled.setdefault(row["lang"], []).append(letters_only(row["text"]))
    return {lang: b" ".join(texts)[:dictionary_bytes] for lang, texts in sampled.items()}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """An encoder per language: short matches count, and frames carry no headers."""
    params = zstandard.ZstdCompressionParameters.from_level(
        3,
        strategy=zstandard.STRATEGY_BTOPT,
        min_match=3,
        search_log=3,
        window_log=17,
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )
    out = []
    for lang in sorted(dictionaries):
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))
    return out


def classify(text: str | None, encoders) -> tuple[str, float]:
    """The language with the shortest encoding, and its lead over the next (0 to 1)."""
    data = letters_only(text) if text else b""
    if not data or not encoders:
        return UNKNOWN, 0.0
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(encoder.compress(b)) for b in blocks), lang) for lang, encoder in encoders)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    (best, lang), (second, _) = sizes[:2]
    return lang, (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the lead) and ``rejected`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = compressors(shared.value)
        for texts in batches:
            yield pd.DataFrame([classify(t, encoders) for t in texts], columns=["lang_pred", "score"])

    # A filter on the verdict would otherwise be pushed below and every text encoded twice,
    # by two Python workers in each task.
    predicted = predicted.asNondeterministic()
    own = others(docs, "lang_pred", "score", "rejected")
    return docs.select(*own, predicted(docs["text"]).alias("__predicted")).select(
        *own,
        F.col("__predicted.lang_pred").alias("lang_pred"),
        F.col("__predicted.score").alias("score"),
        ((F.col("__predicted.lang_pred") == UNKNOWN) | (F.col("__predicted.score") < min_margin)).alias("rejected"),
    )


def held_out(doc_id: str = "doc_id"):
    """The documents that no model is fitted on: a third, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
