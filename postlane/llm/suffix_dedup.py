"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes that starts at two places of the corpus is found in three steps.

1. *Anchors.* Every window of ``LENGTH`` bytes picks the piece of ``PIECE`` bytes inside it
   with the smallest hash, so equal windows pick equal pieces. Neighbouring windows mostly
   pick the same one; such a run is one narrow row (anchor hash, digest of the run's bytes,
   place). An anchor that occurs once in the corpus ends all its windows there. Runs with
   equal digests are copies of each other and need no text at all, however many they are.
2. *Suffix arrays.* What remains are anchors with runs that differ. One copy of each such
   run is cut into blocks of windows, and blocks go to shards by the hash of the bytes that
   all windows of a block share: equal windows always meet. A shard reads its blocks in
   batches. Each batch becomes a sparse suffix array: its window starts, ordered by their
   first ``LENGTH`` bytes. The new array is merge-scanned against every level of the shard's
   index family for equal strings, becomes a level, and levels of equal size are merged, so
   a shard holds a logarithmic number of levels. As only equality over ``LENGTH`` bytes
   matters, suffixes are ordered by a 64-bit fingerprint of these bytes, and every match is
   confirmed byte by byte. Shared bytes that more than ``HOT_BLOCKS`` blocks have, as those at
   the edges of a passage that a third of all documents quote, are no unit of work: these
   blocks are cut into single windows, which are named by 128-bit digests and counted with
   partial sums, so no task holds them together.
3. *Removal.* Repeated windows go back to their documents as ranges of starts.

Texts are shuffled once, by document; everything else is narrow. Hot anchors are joined, not
grouped, so Spark can split them; copies are summed on the map side.

Defined results: a null text is empty; texts shorter than ``LENGTH`` are kept whole; windows
never cross documents; repeated rows are copies of each other, so each loses its long
strings; rows that share an id and have different texts are separate documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from postlane.llm.common import computed, stored
from postlane.llm.rolling import SpanHasher, mixed

LENGTH = 400
PIECE = 120
# Windows per block of a run that goes to the suffix arrays.
BLOCK = 64
# Bytes of a text hashed at a time, and blocks per suffix array of a shard.
STRETCH = 1 << 20
BATCH_ROWS = 2000
# Blocks with the same shared bytes that go to one shard; more are counted window by window.
HOT_BLOCKS = 500
# Matches confirmed at a time.
CONFIRM = 1 << 13

U64 = np.uint64
INDEX_BITS = 24
# A run's start, number of windows and place of the anchor, packed into one number.
PACK = 10


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima inside blocks."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(text: bytes, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: packed place, anchor hash, digest."""
    places, anchors, digests = [], [], []
    whole = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(len(whole) - LENGTH + 1, 0), STRETCH):
        stretch = whole[at : at + STRETCH + LENGTH - 1]
        sums = hasher.prefixes(stretch)
        count = len(stretch) - PIECE + 1
        hashes = mixed((sums[PIECE:] - sums[:count]) * hasher.inverses[:count])
        index = np.arange(count, dtype=U64)
        mask = U64((1 << INDEX_BITS) - 1)
        # The hash decides; among equals the leftmost.
        chosen = (sliding_minimum((hashes & ~mask) | index, LENGTH - PIECE + 1) & mask).astype(np.int64)
        starts = np.flatnonzero(np.diff(chosen, prepend=-1))
        lengths = np.diff(starts, append=len(chosen))
        anchor = chosen[starts]
        spans = hasher.spans(sums, starts, starts + lengths + LENGTH - 1)
        places.append((((at + starts) << PACK | lengths) << PACK) | (anchor - starts))
        anchors.append(hashes[anchor])
        digests.append(mixed(spans + lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))
    if not places:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    return (
        np.concatenate(places),
        np.concatenate(anchors).view(np.int64),
        np.concatenate(digests).view(np.int64),
    )


def unpacked(place: int) -> tuple[int, int, int]:
    mask = (1 << PACK) - 1
    return place >> 2 * PACK, place >> PACK & mask, place & mask


def anchored_runs(docs: DataFrame) -> DataFrame:
    """Narrow rows ``_id``, ``_tag``, ``_place``, ``_anchor``, ``_digest`` of all texts."""
    schema = T.StructType(
        [docs.schema["_id"], docs.schema["_tag"]]
        + [T.StructField(c, T.LongType()) for c in ("_place", "_anchor", "_digest")]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            found = [runs_of(t, hasher) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [pa.array(np.concatenate([f[c] for f in found])) for c in range(3)] if found else []
            if len(rows):
                keys = [batch.column(c).take(pa.array(rows)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *columns], schema=to_arrow_schema(schema))

    return docs.select("_id", "_tag", "_text").mapInArrow(make, schema)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of the listed runs: their class, first window, bytes, and hash of shared bytes."""
    schema = "_anchor bigint, _digest bigint, _single boolean, _first int, _core bigint, _bytes binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for run in runs:
                    start, count, offset = unpacked(run["place"])
                    context = text[start : start + count + LENGTH - 1]
                    sums = hasher.prefixes(np.frombuffer(context, dtype=np.uint8))
                    # Windows by the bytes before the anchor; a block has BLOCK such numbers.
                    for block in range(max(offset - count + 1, 0) // BLOCK, offset // BLOCK + 1):
                        low = max(offset - (block + 1) * BLOCK + 1, 0)
                        high = min(offset - block * BLOCK, count - 1)
                        core = np.array([offset - block * BLOCK]), np.array([offset - (block + 1) * BLOCK + 1 + LENGTH])
                        shared = mixed(hasher.spans(sums, *core) + U64(block)).view(np.int64)[0]
                        out.append(
                            (run["anchor"], run["digest"], run["single"], low, int(shared), context[low : high + LENGTH])
                        )
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
                names = ["_anchor", "_digest", "_single", "_first", "_core", "_bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("_text", "_runs").mapInArrow(make, schema)


class IndexFamily:
    """Levels of sparse suffix arrays over the blocks that a shard has read.

    A level is (fingerprints in order, place of each suffix in ``text``). A place in
    ``repeated`` is set as soon as its window is seen a second time.
    """

    def __init__(self) -> None:
        self.text = bytearray()
        self.repeated = np.zeros(0, dtype=bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.hasher = SpanHasher()

    def add(self, blocks: list[bytes]) -> int:
        """Index a batch; returns where its first block stands in ``text``."""
        base = len(self.text)
        joined = b"".join(blocks)
        self.text += joined
        self.repeated = np.concatenate((self.repeated, np.zeros(len(joined), dtype=bool)))
        ends = np.cumsum([len(b) for b in blocks])
        # A block of n bytes has n - LENGTH + 1 windows.
        counts = np.array([len(b) for b in blocks]) - LENGTH + 1
        firsts = ends - counts - LENGTH + 1
        starts = np.repeat(firsts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        sums = self.hasher.prefixes(np.frombuffer(joined, dtype=np.uint8))
        prints = mixed(self.hasher.spans(sums, starts, starts + LENGTH))
        order = np.argsort(prints, kind="stable")
        level = prints[order], base + starts[order]
        same = np.flatnonzero(level[0][1:] == level[0][:-1])
        self.confirm(level[1][same], level[1][same + 1])
        for older in self.levels:
            self.scan(level, older)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self.merge()
        return base

    def scan(self, new: tuple, old: tuple) -> None:
        """Equal strings of two ordered arrays."""
        at = np.searchsorted(old[0], new[0])
        at[at == len(old[0])] = 0
        hit = np.flatnonzero(old[0][at] == new[0])
        self.confirm(new[1][hit], old[1][at[hit]])

    def merge(self) -> None:
        newer, older = self.levels.pop(), self.levels.pop()
        prints = np.concatenate((older[0], newer[0]))
        order = np.argsort(prints, kind="stable")  # two ordered stretches: one merge
        self.levels.append((prints[order], np.concatenate((older[1], newer[1]))[order]))

    def confirm(self, a: np.ndarray, b: np.ndarray) -> None:
        """Mark the windows at ``a`` and ``b`` whose bytes are equal indeed."""
        # A view, not a copy; gone before the text grows again.
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.text, dtype=np.uint8), LENGTH) if len(a) else None
        for i in range(0, len(a), CONFIRM):
            x, y = a[i : i + CONFIRM], b[i : i + CONFIRM]
            equal = (windows[x] == windows[y]).all(axis=1)
            self.repeated[x[equal]] = True
            self.repeated[y[equal]] = True


def ranges(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of every stretch of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    yield from zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


def repeated_ranges(blocks: DataFrame) -> DataFrame:
    """Per class the ranges of its windows that another class has too."""
    schema = "_anchor bigint, _digest bigint, _low int, _high int"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily()
        seen: list[tuple[int, tuple]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = batch.column(4).to_pylist()
                place = family.add(texts)
                names = zip(*[batch.column(c).to_pylist() for c in range(4)])
                for text, (anchor, digest, single, first) in zip(texts, names):
                    if single:
                        seen.append((place, (anchor, digest, first, len(text) - LENGTH + 1)))
                    place += len(text)
        out = [
            (anchor, digest, first + low, first + high)
            for place, (anchor, digest, first, count) in seen
            for low, high in ranges(family.repeated[place : place + count])
        ]
        for at in range(0, len(out), 10_000):
            columns = list(zip(*out[at : at + 10_000]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            names = ["_anchor", "_digest", "_low", "_high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return blocks.select("_anchor", "_digest", "_single", "_first", "_bytes").mapInArrow(make, schema)


def windows_of(blocks: DataFrame) -> DataFrame:
    """Every window of the blocks: its class, number in the run, and digest of its bytes."""
    schema = "_anchor bigint, _digest bigint, _single boolean, _at int, _string binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = [memoryview(t) for t in batch.column(4).to_pylist()]
                counts = np.array([len(t) - LENGTH + 1 for t in texts])
                rows = np.repeat(np.arange(len(texts)), counts)
                places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                firsts = batch.column(3).to_numpy()[rows] + places
                strings = [
                    hashlib.blake2b(t[i : i + LENGTH], digest_size=16).digest()
                    for t, count in zip(texts, counts.tolist())
                    for i in range(count)
                ]
                kept = [batch.column(c).take(pa.array(rows)) for c in range(3)]
                names = ["_anchor", "_digest", "_single", "_at", "_string"]
                added = [pa.array(firsts, pa.int32()), pa.array(strings, pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=names)

    return blocks.select("_anchor", "_digest", "_single", "_first", "_bytes").mapInArrow(make, schema)


def counted_ranges(blocks: DataFrame) -> DataFrame:
    """What ``repeated_ranges`` gives, for blocks of which any number share their bytes.

    A string is counted on the map side. The repeated ones are stored before they are joined,
    so that Spark may split a hot one. Gathered are a class's own windows, LENGTH at most.
    """
    windows = stored(windows_of(blocks), "windows")
    counted = windows.groupBy("_string").agg(F.count(F.lit(1)).alias("_many"))
    again = stored(counted.where("_many > 1").select("_string"), "strings")
    per_class = (
        windows.where("_single").join(again, "_string").groupBy("_anchor", "_digest").agg(F.sort_array(F.collect_set("_at")).alias("_all"))
    )
    beside = lambda i: F.get(F.col("_all"), i)
    lows = F.filter("_all", lambda x, i: F.coalesce(beside(i - 1) < x - 1, F.lit(True)))
    highs = F.filter("_all", lambda x, i: F.coalesce(beside(i + 1) > x + 1, F.lit(True)))
    edges = F.arrays_zip(lows.alias("_low"), highs.alias("_high"))
    return computed(per_class, "_edges", edges).select("_anchor", "_digest", F.inline("_edges"))


def shared_ranges(blocks: DataFrame) -> DataFrame:
    """Per class the ranges of its windows that another class has too, whatever blocks share."""
    blocks = stored(blocks, "blocks")
    counted = blocks.groupBy("_core").agg(F.count(F.lit(1)).alias("_many"))
    hot = stored(counted.where(F.col("_many") > HOT_BLOCKS).select("_core"), "hot")
    sharded = repeated_ranges(blocks.join(hot, "_core", "left_anti").repartition("_core"))
    return sharded.unionByName(counted_ranges(blocks.join(hot, "_core", "left_semi")))


def removed(docs: DataFrame, kept_text: bool) -> DataFrame:
    """Cut the listed ranges of window starts out of the texts."""
    fields = [docs.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*fields, T.StructField("kept", T.BinaryType())] if kept_text else fields)

    def cut(text: bytes, starts: list | None) -> tuple:
        kept, at, spans, gone = [], 0, 0, 0
        for first, last in sorted((r["first"], r["last"]) for r in starts or ()):
            if first > at or not spans:
                kept.append(text[at:first])
                spans += 1
                at = first
            gone += max(last + LENGTH - at, 0)
            at = max(at, last + LENGTH)
        kept.append(text[at:])
        rest = b"".join(kept)
        row = len(text), gone, spans, hashlib.sha256(rest).hexdigest()
        return (*row, rest) if kept_text else row

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [cut(t, r) for t, r in zip(texts, batch.column(2).to_pylist())]
            if rows:
                columns = [pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.select("_id", "_text", "_ranges").mapInArrow(make, schema)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", kept_text: bool = False) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked
    for, the remaining bytes ``kept``."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("_id"), F.hash(text).alias("_tag"), text.alias("_text"))
    runs = stored(anchored_runs(base), "runs")
    found = (
        runs.groupBy("_anchor")
        .agg(F.count(F.lit(1)).alias("_many"), F.min("_digest").alias("_a"), F.max("_digest").alias("_b"))
        .where("_many > 1")
        .select("_anchor", (F.col("_a") != F.col("_b")).alias("_mixed"))
    )
    # Stored first: joined straight away, an anchor's runs would have to stay in the task
    # that has counted them; so Spark may split a hot one.
    again = stored(runs.join(stored(found, "anchors"), "_anchor"), "again")
    classes = (
        again.where("_mixed")
        .groupBy("_anchor", "_digest")
        .agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct("_id", "_tag", "_place")).alias("_one"))
    )
    listed = classes.select(
        F.col("_one._id").alias("_id"),
        F.col("_one._tag").alias("_tag"),
        F.struct(
            F.col("_one._place").alias("place"),
            F.col("_anchor").alias("anchor"),
            F.col("_digest").alias("digest"),
            (F.col("_many") == 1).alias("single"),
        ).alias("_run"),
    )
    # Per document its own runs: bounded by its length.
    per_doc = listed.groupBy("_id", "_tag").agg(F.collect_list("_run").alias("_runs"))
    cut = blocks_of(base.join(per_doc.hint("shuffle_hash"), same(base, per_doc)).select("_text", "_runs"))
    partial = shared_ranges(cut)
    count = F.shiftright("_place", PACK).bitwiseAND(F.lit((1 << PACK) - 1))
    first = F.shiftright("_place", 2 * PACK)
    all_windows = classes.where("_many > 1").select(
        "_anchor", "_digest", F.lit(0).alias("_low"), F.lit(1 << PACK).alias("_high")
    )
    known = again.where("_mixed").join(partial.unionByName(all_windows), ["_anchor", "_digest"])
    last = F.least(F.col("_high").cast("bigint"), count - 1)
    spans = known.select("_id", "_tag", (first + F.col("_low")).alias("first"), (first + last).alias("last")).unionByName(
        again.where(~F.col("_mixed")).select("_id", "_tag", first.alias("first"), (first + count - 1).alias("last"))
    )
    per_text = spans.groupBy("_id", "_tag").agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))
    whole = base.join(per_text.hint("shuffle_hash"), same(base, per_text), "left").select(base["_id"], "_text", "_ranges")
    return removed(whole, kept_text).withColumnRenamed("_id", id_column)


def same(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_tag"] == b["_tag"])
