"""SimHash near-duplicate groups by deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have
it set. Two fingerprints link if at most two bits differ. Cut into two halves, one half of
such a pair differs by one bit at most. So each distinct fingerprint is indexed under both
halves as they are, and under each half with any one bit replaced by a wildcard: 66 keys.
An equality join on the keys brings the candidates together, and the two whole fingerprints
verify them. A pair counts under the key that names its own difference, so no more than
once per half.

Equal fingerprints are one class from the start. A key that many different fingerprints
share (a large group of near copies) is not paired up, which would cost the square of its
size. Its fingerprints are indexed by their 65 neighbours instead: themselves and all that
differ by one bit. Two fingerprints are within two bits exactly if they have a neighbour
in common, so those under one neighbour are all linked and a link from each to the smallest
loses nothing; at most 65 fingerprints share a neighbour.

Words are runs of anything but the six white-space characters, after lower-casing A-Z; a
text with fewer words than a shingle is one shingle. Defined results: a null text and one
without words have fingerprint zero, linked like any other; repeated rows get equal
results; rows with equal ids and different texts are judged by their texts; a null id
counts as the largest, so a group without any id has a null component. Extra columns are
not read, whatever their names; an empty table gives an empty result. Very long texts are
hashed in pieces of 1 MB, cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import stored
from postlane.llm.graph import components

SHINGLE_WORDS = 3
SEED = 42
BITS, HALF = 64, 32
# Bits in which linked fingerprints may differ. The index is made for two.
DISTANCE = 2
# Fingerprints per key up to which they are paired up.
PAIRED = 16
# Bytes of text and shingles in memory at a time.
PIECE = 1 << 20
BLOCK = 1 << 15

WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text, in blocks that are cut between words."""
    at = 0
    while at < len(text):
        gap = WHITE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def shingles(text: bytes, width: int) -> Iterator[list[bytes]]:
    """All runs of ``width`` words, repeats included, in blocks; a shorter text is one run."""
    carried: list[bytes] = []
    whole = True
    for block in word_blocks(text):
        words = carried + block
        if len(words) >= width:
            whole = False
            yield list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
        carried = words[-(width - 1) :] if width > 1 else []
    if whole and carried:
        yield [b" ".join(carried)]


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The bits that over half of the shingles' hashes have, as an unsigned number."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for block in shingles(text, width):
        total += len(block)
        for at in range(0, len(block), BLOCK):
            part = block[at : at + BLOCK]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype="<u8", count=len(part))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", width: int = SHINGLE_WORDS) -> DataFrame:
    """``_id`` and ``_print`` (the fingerprint as a signed number) of every row."""
    named = docs.select(docs[id_column].alias("_id"), docs["text"].cast("string").alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter(
                (fingerprint(texts[i].as_py() or b"", width) for i in range(len(texts))), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "_print"])

    return named.mapInArrow(make, f"_id {named.schema['_id'].dataType.simpleString()}, _print bigint")


def halves(value: Column) -> list[Column]:
    low = F.lit((1 << HALF) - 1)
    return [value.bitwiseAND(low), F.shiftrightunsigned(value, HALF)]


def variants(prints: DataFrame) -> DataFrame:
    """``_print`` under each of its keys: ``_key`` holds a half's number, a wildcard and the other bits.

    Wildcard 32 stands for none; the half is then whole.
    """
    keys = []
    for number, half in enumerate(halves(F.col("_print"))):
        for wild in range(HALF + 1):
            rest = half.bitwiseAND(F.lit(~(1 << wild) & ((1 << HALF) - 1)))
            keys.append(F.lit((number * (HALF + 1) + wild) << HALF).bitwiseOR(rest))
    return prints.select("_print", F.explode(F.array(*keys)).alias("_key"))


def links_of(a: Column, b: Column, key: Column) -> Column:
    """Whether two fingerprints under a key are linked and differ in its half as it says."""
    differing = a.bitwiseXOR(b)
    slot = F.shiftright(key, HALF)
    low, high = halves(differing)
    own = F.when(slot <= HALF, low).otherwise(high)
    wild = slot % (HALF + 1)
    named = F.when(wild == HALF, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), wild.cast("int")))
    return (F.bit_count(differing) <= DISTANCE) & (own == named)


def neighbours(prints: DataFrame) -> DataFrame:
    """``_print`` under itself and all fingerprints that differ from it by one bit, as ``_near``."""
    flips = [0, *[(1 << b) - (1 << BITS if b == BITS - 1 else 0) for b in range(BITS)]]
    near = [F.col("_print").bitwiseXOR(F.lit(f).cast("bigint")) for f in flips]
    return prints.select("_print", F.explode(F.array(*near)).alias("_near"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (``x``, ``y``) that connect all of the distinct ``_print`` within two bits of each other.

    Spark sizes an exploded table like one that is not, 66 times too low, and would send it
    to the driver to broadcast it. The hints have these joins shuffled.
    """
    indexed = variants(prints)
    shared = indexed.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    members = stored(indexed.join(shared.hint("merge"), "_key"), "members")
    few = members.where(F.col("_many") <= PAIRED).select("_key", "_print")
    left, right = (few.select("_key", F.col("_print").alias(n)) for n in ("x", "y"))
    verified = (F.col("x") < F.col("y")) & links_of(F.col("x"), F.col("y"), F.col("_key"))
    pairs = left.join(right.hint("merge"), "_key").where(verified).select("x", "y")
    around = neighbours(members.where(F.col("_many") > PAIRED).select("_print").distinct())
    smallest = around.groupBy("_near").agg(F.min("_print").alias("x"), F.count(F.lit(1)).alias("_many"))
    joined = around.join(smallest.where("_many > 1").select("_near", "x").hint("merge"), "_near")
    return pairs.unionByName(joined.select("x", F.col("_print").alias("y")).where("x <> y"))


def near_duplicate_prints(
    docs: DataFrame, id_column: str = "doc_id", width: int = SHINGLE_WORDS
) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    signed = stored(with_fingerprints(docs, id_column, width), "prints")
    classes = stored(signed.groupBy("_print").agg(F.min("_id").alias("_least")), "classes")
    roots = components(links(classes.select("_print")))
    named = classes.join(roots, F.col("node") == F.col("_print"), "left")
    placed = named.select("_print", "_least", F.coalesce("root", "_print").alias("_root"))
    smallest = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_print = stored(placed.join(smallest, "_root").select("_print", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("_print"), BITS // 4, "0"))
    return signed.join(of_print, "_print").select(
        F.col("_id").alias(id_column), digits.alias("fingerprint"), "component_id"
    )
