"""Near-duplicate groups by circulant MinHash, with every link confirmed on full sets.

A document is the set of its distinct word shingles, held as 64-bit hashes. Two bijections
of the 32-bit numbers stand in for the two permutations: the first scatters the shingles,
the second, shifted circularly by k, orders them for the k-th coordinate. The signature is
cut into bands; documents that agree on a whole band are candidates. With 25 bands of 5 a
pair at the threshold of 0.85 is missed with probability 4e-7.

Equal sets are one class from the start, so copies cost a row each, whatever their number.
Within a bucket pairs are not listed. Rounds of centres are compared instead: a few members
of each bucket against its other members that are not yet known to be in the centre's
component. Confirmed links merge components, centres then leave the bucket, and a bucket
ends when one component, or one member, is left. Each round takes four times as many
centres as the round before, so no pair of different components that shares a bucket goes
unexamined, while a large group of near copies needs few comparisons per member. What no
pair could reach is never compared: two sets share at most the shingles that neither has
for itself alone among the candidates, so sizes and these counts bound their likeness
exactly. Nor is a pair whose parities differ too often: each set's shingles are dealt into
slots, of which one bit tells whether an odd number fell in, and every slot that differs
holds a shingle that only one of the two sets has. So near copies that are just not alike
enough are not listed as pairs. Nor are pairs confirmed whose signatures' low bits agree far less often than
those of any pair at the threshold would, by five standard errors (which misses one in
three million of such pairs, and can be switched off). Both keep the many copies
that are edited too much to be linked, and would otherwise meet each other in every bucket,
out of the comparisons. Components are merged by contracting
edges, as joins; nothing is collected.

Words are runs of anything but the six white-space characters, after lower-casing A-Z; a
text with fewer words than a shingle is one shingle. Defined results: a null text or one
without words has an empty set, is linked with nothing and kept; rows with equal ids and
texts get equal results; rows with equal ids and different texts are judged by their texts;
a null id counts as the largest, so a group without any id has a null component and all its
rows are kept. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlane.llm.common import stored
from postlane.llm.rolling import SpanHasher, mixed
from postlane.operators.ordering import top_per_group

SHINGLE_WORDS = 3
THRESHOLD_PERCENT = 85
BANDS = 25
BAND_ROWS = 5
# Coordinates whose low bits foretell the likeness of two sets, and bits kept of each.
SKETCH = 256
SKETCH_BITS = 4
# Pairs so many standard errors below the threshold by this estimate are not confirmed.
ERRORS = 5
# Slots whose parities bound from below how many shingles two sets do not share.
SLOTS = 1 << 10
# Bits of the filter that keeps rows that no class wants out of the shuffle of texts.
FILTER_BITS = 1 << 24
# Bytes hashed at a time; longer texts are cut between words.
PIECE = 1 << 20
# Coordinates times shingles in memory at a time.
BLOCK = 1 << 18
CENTRE_GROWTH = 4

U32, U64 = np.uint32, np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(text: bytes, hasher: SpanHasher) -> np.ndarray:
    """Hash of every word of a text, in order."""
    out, at = [], 0
    whole = np.frombuffer(text, dtype=np.uint8)
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        if end < len(whole):
            gaps = np.flatnonzero(WHITE[whole[end : end + PIECE]])
            end = end + int(gaps[0]) if len(gaps) else len(whole)
        piece = LOWER[whole[at:end]]
        edges = np.diff(np.concatenate(([True], WHITE[piece], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        out.append(mixed(hasher.spans(hasher.prefixes(piece), starts, ends)))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


def shingle_set(text: bytes, hasher: SpanHasher, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = word_hashes(text, hasher)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    joined = np.full(n, U64(width))
    for i in range(width):
        joined = mixed(joined * U64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(joined)


def scatter(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place: the stand-in for a permutation."""
    x ^= x >> U32(16)
    x *= U32(first)
    x ^= x >> U32(13)
    x *= U32(second)
    x ^= x >> U32(16)
    return x


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Minimum of the second permutation, shifted by k, over the first's image, for each k."""
    placed = scatter((shingles >> U64(32)).astype(U32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(1, size + 1, dtype=U32)[:, None]
    least = np.full(size, U32(0xFFFFFFFF))
    step = max(1, BLOCK // size)
    for at in range(0, len(placed), step):
        ranks = scatter(placed[None, at : at + step] + shifts, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(least, ranks.min(axis=1), out=least)
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=U64)
    for column in signature.reshape(bands, rows).T:
        key = mixed(key * U64(0x9E3779B97F4A7C15) + column.astype(U64))
    return key.view(np.int64)


def packed_sketch(signature: np.ndarray) -> np.ndarray:
    """The low bits of all coordinates, packed into 64-bit numbers."""
    low = (signature & U32((1 << SKETCH_BITS) - 1)).astype(U64).reshape(-1, 64 // SKETCH_BITS)
    places = np.arange(0, 64, SKETCH_BITS, dtype=U64)
    return (low << places).sum(axis=1, dtype=U64).view(np.int64)


def packed_parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each slot got an odd number of shingles, packed into 64-bit numbers."""
    slots = (shingles >> U64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=SLOTS) & 1).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    hasher = SpanHasher()
    for batch in batches:
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            yield batch.column(0).slice(i, 1), shingle_set(text or b"", hasher, width)


def _batched(rows: Iterator[list], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose first value is a one-row array."""
    held: list[list] = []

    def flush():
        ids = pa.concat_arrays([r[0] for r in held])
        rest = [pa.array([r[c] for r in held], type=schema.field(c).type) for c in range(1, len(schema))]
        return pa.RecordBatch.from_arrays([ids, *rest], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield flush()
            held.clear()
    if held:
        yield flush()


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``_id``, ``_tag`` (hash of the text), ``_n`` (set size), ``_set`` (digest of the set),
    ``_keys`` (bands), ``_bits``."""
    named = docs.select(F.struct("_id", "_tag").alias("_row"), "_text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for row_id, found in _sets(batches, width):
                keys = bits = found.view(np.int64)
                if len(found):
                    signature = circulant_signature(found, max(bands * rows, SKETCH))
                    keys, bits = band_keys(signature[: bands * rows], bands, rows), packed_sketch(signature[:SKETCH])
                yield [row_id, len(found), set_digest(found), keys, bits]

        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batched(each(), to_arrow_schema(schema))

    schema = T.StructType(
        [
            T.StructField("_row", named.schema["_row"].dataType),
            T.StructField("_n", T.LongType()),
            T.StructField("_set", T.BinaryType()),
            T.StructField("_keys", T.ArrayType(T.LongType())),
            T.StructField("_bits", T.ArrayType(T.LongType())),
        ]
    )
    return named.mapInArrow(make, schema).select("_row._id", "_row._tag", "_n", "_set", "_keys", "_bits")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``_set``, its ``_shingles`` and their parities ``_odd`` for rows with ``_set`` and ``_text``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Another text under the same id is not this set's text.
        rows = (
            [name, found.view(np.int64), packed_parities(found)]
            for name, found in _sets(batches, width)
            if name[0].as_py() == set_digest(found)
        )
        numbers = pa.list_(pa.int64())
        schema = pa.schema([("_set", pa.binary()), ("_shingles", numbers), ("_odd", numbers)])
        yield from _batched(rows, schema, 100)

    return docs.select("_set", "_text").mapInArrow(make, "_set binary, _shingles array<bigint>, _odd array<bigint>")


def probably_in(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """Those of the rows whose named columns' hash is that of a wanted row: all wanted ones, and few others.

    A bit for each hash, in 64-bit numbers that are broadcast; their size is bounded, and more
    wanted rows than bits let more others pass.
    """
    place = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    places = wanted.select(place.alias("_place"))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    filled = places.groupBy(F.expr("_place div 64").alias("_word")).agg(F.bit_or(bit).alias("_filled"))
    tried = rows.withColumn("_place", place).withColumn("_word", F.expr("_place div 64"))
    met = tried.join(F.broadcast(filled), "_word").where("shiftrightunsigned(_filled, cast(_place % 64 as int)) & 1 = 1")
    return met.select(*[rows[c] for c in rows.columns])


def own_shingles(sets: DataFrame) -> DataFrame:
    """``_own``: how many of a set's shingles no other candidate has; sets without any are left out.

    Counted over all candidates' full sets, with partial counts per shingle. Sets go by their
    number ``_no`` meanwhile, as shorter rows are shuffled.
    """
    each = sets.select("_no", F.explode("_shingles").alias("_shingle"))
    counted = each.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_many"), F.min("_no").alias("_no"))
    alone = counted.where("_many = 1").groupBy("_no").agg(F.count(F.lit(1)).alias("_own"))
    return alone.join(sets.select("_no", "_set"), "_no").select("_set", "_own")


def may_link(size_a: Column, own_a: Column, size_b: Column, own_b: Column, percent: int) -> Column:
    """Whether the threshold is within reach: two sets share at most what neither has alone."""
    most = F.least(size_a - own_a, size_b - own_b)
    return 100 * most >= percent * (size_a + size_b - most)


def may_agree(size_a: Column, odd_a: Column, size_b: Column, odd_b: Column, percent: int) -> Column:
    """Whether the threshold is within reach: a slot whose parities differ holds a shingle of one set alone."""
    differing = F.lit(0)
    for i in range(SLOTS // 64):
        differing = differing + F.bit_count(F.get(odd_a, F.lit(i)).bitwiseXOR(F.get(odd_b, F.lit(i))))
    return (100 + percent) * differing <= (100 - percent) * (size_a + size_b)


def may_be_alike(a: Column, b: Column, percent: int) -> Column:
    """Whether the packed sketches agree as often as those of a linked pair do, but for chance.

    ``ERRORS`` standard errors below what a pair at the threshold shows: one in three
    million of such pairs would be missed, as many as the bands miss.
    """
    chance = 1 / (1 << SKETCH_BITS)
    share = percent / 100 + (1 - percent / 100) * chance
    least = SKETCH * share - ERRORS * (SKETCH * share * (1 - share)) ** 0.5
    ones = sum(1 << i for i in range(0, 63, SKETCH_BITS))
    differing = F.lit(0)
    for i in range(SKETCH * SKETCH_BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in range(SKETCH_BITS.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << shift))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return SKETCH - differing >= least


def first_shared(key: Column, a: Column, b: Column) -> Column:
    """Whether the bucket is the first that two members share, so that a pair is met once."""
    return F.element_at(F.array_intersect(a, b), 1) == key


def within_reach(low: Column, high: Column, percent: int) -> Column:
    """Whether any partner of a size between the two bounds could be linked with the row."""
    size, shared = F.col("_n"), F.col("_n") - F.col("_own")
    smallest = percent * size
    largest = shared * (100 + percent) - percent * size
    return (100 * shared >= percent * size) & (percent * low <= largest) & (100 * high >= smallest)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose full sets reach the threshold."""
    pairs = stored(pairs, "pairs")
    full = sets.select("_set", "_shingles")
    needed = probably_in(full, pairs.select(F.explode(F.array("a", "b")).alias("_set")), "_set")
    left, right = needed.toDF("a", "_of_a"), needed.toDF("b", "_of_b")
    both = F.size(F.array_intersect("_of_a", "_of_b"))
    union = F.size("_of_a") + F.size("_of_b") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * union).select("a", "b")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``_label`` of every ``_set`` after joining the components that links connect.

    Components are nodes, links edges. In each step a node goes over to its smallest
    neighbour and on to that one's, edges are redrawn between the nodes that are left,
    and edges inside one node vanish. It ends when no edge is left: after one step for a
    star, and after few for any graph, as every node with a smaller neighbour goes.
    """
    a = labels.select(F.col("_set").alias("a"), F.col("_label").alias("x"))
    b = labels.select(F.col("_set").alias("b"), F.col("_label").alias("y"))
    edges = stored(links.join(a, "a").join(b, "b").select("x", "y").where("x <> y").distinct(), "edges")
    moved = None
    while edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        nearest = stored(ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")), "nearest")
        onward = nearest.select(F.col("x").alias("to"), F.col("to").alias("root"))
        step = stored(nearest.join(onward, "to").select("x", "root"), "step")
        if moved is None:
            moved = step
        else:
            after = step.select(F.col("x").alias("root"), F.col("root").alias("_root"))
            followed = moved.join(after, "root", "left").select("x", F.coalesce("_root", "root").alias("root"))
            moved = stored(followed, "moved")
        by_x = step.select("x", F.col("root").alias("_x"))
        by_y = step.select(F.col("x").alias("y"), F.col("root").alias("_y"))
        redrawn = edges.join(by_x, "x").join(by_y, "y").where("_x <> _y")
        edges = stored(redrawn.select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct(), "edges")
    if moved is None:
        return labels
    found = moved.select(F.col("x").alias("_label"), "root")
    return stored(
        labels.join(found, "_label", "left").select("_set", F.coalesce("root", "_label").alias("_label")), "labels"
    )


def near_duplicate_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    width: int = SHINGLE_WORDS,
    percent: int = THRESHOLD_PERCENT,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    foretell: bool = True,
) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Without ``foretell`` every pair that shares a band and may reach the threshold is
    confirmed on its full sets, however unlike its packed bits are.
    """
    text = docs["text"].cast("string")
    base = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("_text"))
    signed = stored(signatures(base, width, bands, rows), "signed")
    # One row per distinct set, with its smallest id and the hash of a text under this id.
    classes = stored(
        signed.where("_n > 0")
        .groupBy("_set")
        .agg(
            F.min("_id").alias("_id"),
            F.min(F.struct(F.col("_id").isNull(), "_id", "_tag"))["_tag"].alias("_tag"),
            F.first("_keys").alias("_keys"),  # equal for equal sets, like all but the id
            F.first("_bits").alias("_bits"),
            F.first("_n").alias("_n"),
        ),
        "classes",
    )
    members = classes.select("_set", "_n", F.explode("_keys").alias("_key"))
    shared = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select("_key")
    candidates = stored(members.join(shared, "_key"), "candidates")
    # Sets that share no bucket stay alone and need no label.
    labels = stored(candidates.select("_set", F.col("_set").alias("_label")).distinct(), "labels")
    # Texts of one document per class that shares a bucket; each becomes its set once.
    wanted = stored(candidates.select("_set").distinct().join(classes.select("_set", "_id", "_tag"), "_set"), "wanted")
    asked = probably_in(base, wanted, "_id", "_tag")
    same = asked["_id"].eqNullSafe(wanted["_id"]) & (asked["_tag"] == wanted["_tag"])
    texts = asked.join(wanted.hint("shuffle_hash"), same).select("_set", "_text")
    once = full_sets(texts, width).dropDuplicates(["_set"])
    sets = stored(once.withColumn("_no", F.monotonically_increasing_id()), "sets")
    lonely = stored(own_shingles(sets), "own")
    marks = stored(classes.select("_set", "_keys", "_bits").join(sets.select("_set", "_odd"), "_set"), "marks")
    buckets = candidates.join(lonely, "_set", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))

    centres = 1
    while True:
        bounds = buckets.join(labels, "_set").groupBy("_key").agg(
            F.min("_label").alias("_first"),
            F.max("_label").alias("_last"),
            F.min("_n").alias("_low"),
            F.max("_n").alias("_high"),
        )
        open_buckets = bounds.where("_first <> _last").select("_key", "_low", "_high")
        live = stored(
            buckets.join(open_buckets, "_key")
            .where(within_reach(F.col("_low"), F.col("_high"), percent))
            .drop("_low", "_high")
            .join(labels, "_set")
            .join(marks, "_set"),
            "live",
        )
        if not live.limit(1).count():
            break
        # The sets with the fewest shingles of their own lie in the middle of their group.
        order = [F.col("_own"), F.xxhash64("_set"), F.col("_set")]
        chosen = stored(
            top_per_group(live, ["_key"], order, centres, "_place").select(
                "_key",
                F.col("_set").alias("a"),
                F.col("_n").alias("_na"),
                F.col("_own").alias("_own_a"),
                F.col("_keys").alias("_keys_a"),
                F.col("_bits").alias("_bits_a"),
                F.col("_odd").alias("_odd_a"),
                F.col("_label").alias("_la"),
                "_place",
            ),
            "centres",
        )
        # A centre meets all members but the centres before it, which have met it.
        as_centre = chosen.select("_key", F.col("a").alias("_set"), F.col("_place").alias("_met"))
        ranked = live.join(as_centre, ["_key", "_set"], "left")
        other = (F.col("_label") != F.col("_la")) & (F.col("_met").isNull() | (F.col("_met") > F.col("_place")))
        reach = may_link(F.col("_n"), F.col("_own"), F.col("_na"), F.col("_own_a"), percent)
        agree = may_agree(F.col("_n"), F.col("_odd"), F.col("_na"), F.col("_odd_a"), percent)
        once = first_shared(F.col("_key"), F.col("_keys"), F.col("_keys_a"))
        alike = may_be_alike(F.col("_bits"), F.col("_bits_a"), percent) if foretell else F.lit(True)
        pairs = (
            ranked.join(chosen, "_key")
            .where(other & reach & agree & alike & once)
            .select(F.least("a", "_set").alias("a"), F.greatest("a", "_set").alias("b"))
            .distinct()
        )
        labels = merged_labels(labels, stored(confirmed(pairs, sets, percent), "links"))
        buckets = stored(ranked.where("_met is null").select("_set", "_n", "_key", "_own"), "buckets")
        centres *= CENTRE_GROWTH

    placed = (
        classes.select("_set", "_id")
        .join(labels, "_set", "left")
        .withColumn("_label", F.coalesce("_label", "_set"))
    )
    groups = placed.groupBy("_label").agg(F.min("_id").alias("_component"))
    of_set = placed.select("_set", "_label").join(groups, "_label").select("_set", "_component")
    out = signed.select("_id", "_n", "_set").join(of_set, "_set", "left")
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_column),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
