"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds the hash of every distinct shingle that falls below a fixed fraction of
the hash range; a text with shingles but none below it holds its smallest one. The
fraction, not a fixed length, bounds a sketch: it grows with its document, so the sketch
of a union is the union of sketches, and the share of a short text inside a very long one
(containment) is estimated as well as the resemblance of two equals. Sketches are arrays
of 31-bit hashes made by column functions; a fingerprint is their sorted hexadecimal text.

Shingles are runs of five words (anything between the six white-space characters) after
lower-casing; a shorter text is one shingle. Defined results: a null text counts as empty;
a text without words has an empty sketch; two empty sketches have likeness 1, an empty and
another one 0; equal texts have equal fingerprints wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import computed, shingle_hashes, text_of, words_of
from postlane.operators.ordering import global_position

SHINGLE_WORDS = 5
# Share of all shingle hashes that a sketch retains.
FRACTION = 0.25
HASH_RANGE = 1 << 31
DIGITS = 8


def add_sketch(
    df: DataFrame, text: Column, name: str, width: int = SHINGLE_WORDS, fraction: float = FRACTION
) -> DataFrame:
    """Adds the sketch of a text as a sorted array of numbers below 2^31."""
    words = f"{name}_words"
    df = computed(df, words, F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))
    hashes = F.col(words)
    whole = F.array(F.xxhash64(hashes))
    shingles = (
        F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
        .when(F.size(hashes) < width, whole)
        .otherwise(shingle_hashes(hashes, width))
    )
    df = computed(df, f"{name}_all", F.transform(shingles, lambda h: F.shiftrightunsigned(h, 33).cast("int"))).drop(words)
    everything = F.col(f"{name}_all")
    low = F.filter(everything, lambda h: h < int(HASH_RANGE * fraction))
    least = F.filter(F.array(F.array_min(everything)), lambda h: h.isNotNull())
    kept = F.when(F.array_min(everything) < int(HASH_RANGE * fraction), low).otherwise(least)
    return computed(df, name, F.sort_array(F.array_distinct(kept))).drop(f"{name}_all")


def to_fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), DIGITS, "0")), "")


def from_fingerprint(fingerprint: Column) -> Column:
    """The sketch that a fingerprint spells."""
    count = (F.length(fingerprint) / DIGITS).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.conv(fingerprint.substr(i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("int")
    )


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two texts' shingles together: the union, where a lone high hash gives way."""
    union = F.sort_array(F.array_union(a, b))
    limit = int(HASH_RANGE * fraction)
    return F.when(F.array_min(union) < limit, F.filter(union, lambda h: h < limit)).otherwise(F.slice(union, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared hashes by all hashes of the two."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total).cast("double")


def containment(part: Column, whole: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` has, however unequal they are.

    Only hashes below the threshold are in both sketches if they are in both texts, so a
    part that has none below says nothing: null, unless it has no shingles at all, or the
    sketches are equal.
    """
    low = F.filter(part, lambda h: h < int(HASH_RANGE * fraction))
    return (
        F.when((F.size(part) == 0) | (part == whole), 1.0)
        .when(F.size(low) > 0, F.size(F.array_intersect(low, whole)) / F.size(low))
        .cast("double")
    )


def compare_with_edit(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter replaced by the start of the next document's
    text, by ascending id (after the last the first; rows with equal ids share the next
    id, and its row with the smallest text hash is taken). Neighbours are found on ids
    and lengths alone. Texts are shuffled once, by id; besides, every document sends
    the few code points that its predecessor needs.
    """
    text = text_of(docs)
    # Keys are texts without nulls, so that grouping and joining by them agree on a partitioning.
    key_of = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    base = docs.select(F.col(id_column).alias("_id"), key_of(id_column).alias("_key"), text.alias("_text"))
    sketched = add_sketch(base, F.col("_text"), "_sketch")

    sizes = docs.select(F.col(id_column).alias("_id"), F.length(text).alias("_n"))
    ids = sizes.groupBy("_id").agg(F.max("_n").alias("_n"))
    placed = global_position(ids, ["_id"], "_at")
    total = placed.count()
    before = placed.select(
        key_of("_id").alias("_before"),
        F.floor(F.col("_n") / 4).cast("int").alias("_wanted"),
        ((F.col("_at") + 1) % F.lit(max(total, 1))).alias("_at"),
    )
    # For every id the document before it and how much of this text it needs.
    needs = placed.select("_at", key_of("_id").alias("_key")).join(before, "_at").drop("_at")
    heads = (
        sketched.join(needs, "_key")
        .select(
            "_before",
            # Reads the id as well: with the same columns as below, Spark shuffles them once.
            F.xxhash64("_id", "_text").alias("_order"),
            F.struct(
                F.col("_text").substr(F.lit(1), F.col("_wanted")).alias("head"), F.col("_sketch").alias("sketch")
            ).alias("_next"),
        )
        .groupBy("_before")
        .agg(F.min_by("_next", "_order").alias("_next"))
    )
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.col("_text").substr(F.lit(1), n - quarter), F.col("_next.head").substr(F.lit(1), quarter)
    )
    paired = sketched.join(heads.withColumnRenamed("_before", "_key"), "_key").select(
        "_id", "_sketch", n.cast("bigint").alias("_n"), F.col("_next.sketch").alias("_next"), edited.alias("_edited")
    )
    both = add_sketch(paired, F.col("_edited"), "_edited_sketch")
    return both.select(
        F.col("_id").alias(id_column),
        F.col("_n").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        to_fingerprint(F.col("_sketch")).alias("fingerprint"),
        to_fingerprint(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next")).alias("near_next"),
        containment(F.col("_sketch"), F.col("_edited_sketch")).alias("contained_in_edited"),
        containment(F.col("_sketch"), F.col("_next")).alias("contained_in_next"),
    )
