"""A corpus for training from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``, so a stage's result can be written as Parquet
and read as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.llm import language_id, line_dedup, mixing, near_dup, piece_bpe
from postlane.llm.common import stored, table
from postlane.llm.queries import MIN_SITES, MIXTURE, MIXTURE_REST, MIXTURE_SEED

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near duplicates share 80 percent of their five-word shingles; 30 bands of 4 miss such a pair
# with probability 1.4e-7.
NEAR_WORDS, NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 5, 80, 30, 4

# A learned classifier, sketches and a tokenizer: no SQL twin.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a clear language go; a missing language is filled in.

    Null and empty texts and those without letters go, whatever their ``lang``; ties between
    languages are rejections. Repeated rows are judged alike; null ids and sources stay.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    judged = language_id.identify(docs, model).where(~F.col("rejected"))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def remove_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document that had nothing else goes with them.

    A null text counts as empty; texts that were empty before stay. A null source is a site
    of its own. Repeated rows keep and lose the same lines, the first occurrence of a line by
    id and place being kept.
    """
    cleaned = line_dedup.remove_spread_lines(docs, MIN_SITES)
    some_left = (F.col("n_removed") == 0) | line_dedup.has_word(F.col("text"))
    return cleaned.where(some_left).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays, that with the smallest id.

    Rows are named by id and text: a null id is the largest, and among equal ids the text's
    digest decides. Of rows with the same id and text the one with the smallest other columns
    stays; map tasks reduce such rows before any text is shuffled.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    named = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", digest.alias("digest")))
    groups = near_dup.near_duplicate_groups(
        named, "_row", width=NEAR_WORDS, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS
    )
    kept = groups.where("kept").select(F.col("_row").alias("_kept")).distinct()
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = named.groupBy("_row").agg(F.first("text").alias("text"), F.min(F.struct(*others)).alias("_others"))
    stay = once.join(kept.hint("shuffle_hash"), F.col("_row") == F.col("_kept"))
    return stay.select("_row.doc_id", "text", "_others.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target mixture, in global random order.

    A null source belongs to the rest of the mixture; null ids draw like the word null, so
    repeated rows are drawn alike. A source without any text keeps its rate of one.
    """
    mixed = mixing.mix_sources(docs, MIXTURE, MIXTURE_REST, epochs=1.0, seed=MIXTURE_SEED)
    return mixed.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to.

    A null or empty text has the end id alone; repeated rows get equal ids; other columns stay.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.encode_and_verify(docs.select("doc_id", "lang", "source", "text"), model, keep_text=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_spread_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("piece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
