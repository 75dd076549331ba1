"""Alignment of two tokenizers' tokens by pointer jumping.

Both encode the same bytes, a space and the text. Every token points to the farthest-right
token of the other side that it overlaps, or to itself if none ends further right. Doubling
all successors at once (each token takes over its successor's successor) converges to the
last token of its component, whose end is a place where tokens of both sides end. That
label makes the groups: the smallest runs of tokens of both sides that cover the same bytes.

A text is cut where single spaces stand between other characters: no token of either side
reaches across. Each distinct chunk among a few texts is encoded and aligned once, all
chunks together as arrays. The counts of linked id pairs are summed over a few texts before
they leave their task, then over the corpus. A row's pairs meet the corpus-wide counts in
one join; the counts are broadcast if they are few (they are bounded by the vocabularies,
not by the corpus), else shuffled. The model files are read on the driver and broadcast.

Defined results: null and empty texts, and those whose bytes the tokens of either side do
not spell out again, have no tokens: all numbers are zero and the groups an empty string;
repeated rows count as often as they stand there and get equal results; a null id is kept;
extra columns are not read, whatever their names; an empty table gives an empty result.
A very long text is handled by chunks; only its ids and pairs are held as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import bounded, stored

SPACE = "▁"
# Characters of the texts whose chunks are encoded together.
TOGETHER = 1 << 22
# Pairs of ids up to which their counts are broadcast: 24 bytes each.
BROADCAST_PAIRS = 1_000_000
# Python's white space includes that of both tokenizers, so these cuts are safe.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, the other way round.

    Printable bytes stand for themselves; the others take the letters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelSide:
    """Encoder of a byte-level model; every chunk stands after a space."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_of = [b""] * self.model.get_vocab_size(with_added_tokens=True)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()

    def encode(self, chunks: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        return [f.ids for f in found]


class PieceSide:
    """Encoder of a piece model, which puts the space before a chunk itself."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token of both sides, A before B, the last token of its component.

    Ends are places in the same bytes. A's tokens always have a successor among B's, the one
    that covers their last byte; B's tokens have one among A's unless both end there.
    """
    many = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a) + many
    to_a = np.searchsorted(ends_a, ends_b)
    own = np.arange(many, many + len(ends_b))
    successor = np.concatenate((to_b, np.where(ends_a[to_a] > ends_b, to_a, own)))
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor
        successor = doubled


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (A, B) whose tokens overlap, ordered by A."""
    starts = np.concatenate(([0], ends_a[:-1]))
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a)
    each = last - first + 1
    before = np.cumsum(each) - each
    within = np.arange(each.sum()) - np.repeat(before, each)
    return np.repeat(np.arange(len(ends_a)), each), np.repeat(first, each) + within


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and where each list ends."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    whole = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
    return whole, np.cumsum(sizes)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, given where each run ends."""
    totals = np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))]
    return np.diff(totals)


class Aligner:
    """Aligns texts by two encoders; ``pair`` numbers stand for an A id and a B id."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side.bytes_of]) for side in (a, b))
        # Spelled ids with what follows them: a comma inside a run, else the run's end.
        spelled = [[f"{i}{mark}" for mark in ",|;" for i in range(len(side.bytes_of))] for side in (a, b)]
        self.spelled_a, self.spelled_b = (np.array(s, dtype=object) for s in spelled)

    def spells(self, side, ids: list[int], chunk: bytes) -> bool:
        return b"".join(map(side.bytes_of.__getitem__, ids)) == chunk

    def aligned(self, chunks: list[str]) -> dict:
        """Per chunk: whether both sides spell it, its figures, groups as text, and pairs."""
        ids_a, ids_b = self.a.encode(chunks), self.b.encode(chunks)
        raw = [b" " + c.encode() for c in chunks]
        good = np.fromiter(
            (self.spells(self.a, x, c) and self.spells(self.b, y, c) for x, y, c in zip(ids_a, ids_b, raw)),
            dtype=bool,
            count=len(chunks),
        )
        a, last_a = flat([x if g else [] for x, g in zip(ids_a, good)])
        b, last_b = flat([x if g else [] for x, g in zip(ids_b, good)])
        found = {"good": good, "n_a": np.diff(last_a, prepend=0), "n_b": np.diff(last_b, prepend=0)}
        none = np.zeros(len(chunks), dtype=np.int64)
        if not len(a):
            return found | {"n_groups": none, "links": none, "pairs": np.empty(0, np.int64), "shown": [""] * len(chunks)}
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        label = terminals(ends_a, ends_b)
        label_a, label_b = label[: len(a)], label[len(a) :]
        closes_a = np.append(label_a[1:] != label_a[:-1], True)
        closes_b = np.append(label_b[1:] != label_b[:-1], True)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        # In print a group's B tokens follow its A tokens.
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        shown = np.empty(len(a) + len(b), dtype=object)
        shown[at_a] = self.spelled_a[a + closes_a * len(self.sizes_a)]
        shown[at_b] = self.spelled_b[b + closes_b * 2 * len(self.sizes_b)]
        shown = shown.tolist()
        edges = [0, *(last_a + last_b).tolist()]
        places_a, places_b = linked(ends_a, ends_b)
        return found | {
            "n_groups": sums(closes_a, last_a),
            "links": sums(np.bincount(places_a, minlength=len(a)), last_a),
            "pairs": a[places_a] << 32 | b[places_b],
            "shown": ["".join(shown[i:j])[:-1] for i, j in zip(edges, edges[1:])],
        }

    def chunks_of(self, text: str | None) -> list[str]:
        return CUT.split(text) if text else []

    def texts(self, texts: list[str | None]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """Per text (n_a, n_b, n_groups, n_links, groups, pairs, times), and the pairs' counts over all."""
        split = [self.chunks_of(t) for t in texts]
        number: dict[str, int] = {}
        places = [[number.setdefault(c, len(number)) for c in chunks] for chunks in split]
        known = self.aligned(list(number))
        # A text with a chunk that is not spelled out has no tokens.
        places = [p if known["good"][p].all() else [] for p in places]
        which, last = flat(places)
        figures = [sums(known[name][which], last) for name in ("n_a", "n_b", "n_groups", "links")]
        link_ends = np.cumsum(known["links"])
        each = known["links"][which]
        before = np.cumsum(each) - each
        gathered = known["pairs"][np.repeat((link_ends - known["links"])[which] - before, each) + np.arange(each.sum())]
        edges = np.concatenate(([0], np.cumsum(figures[3])))
        out = []
        for row, chunks in enumerate(places):
            shown = ";".join(map(known["shown"].__getitem__, chunks))
            digest = hashlib.sha256(shown.encode()).hexdigest() if chunks else ""
            pairs, times = np.unique(gathered[edges[row] : edges[row + 1]], return_counts=True)
            out.append((*(int(f[row]) for f in figures), digest, pairs, times))
        often = np.bincount(which, minlength=len(number))
        total, inverse = np.unique(known["pairs"], return_inverse=True)
        counts = np.bincount(inverse, weights=np.repeat(often, known["links"]), minlength=len(total)).astype(np.int64)
        return out, (total[counts > 0], counts[counts > 0])


def aligned_rows(docs: DataFrame, id_column: str, byte_model: str, piece_model: str) -> DataFrame:
    """Figures of every text with its distinct pairs, and rows of counts.

    A row of counts, marked by a null ``_n_a``, holds how often each pair occurs in a task's
    next few texts, so that what goes into the corpus-wide counts is summed beforehand.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_model, encoding="utf-8") as file:
        model_a = context.broadcast(file.read())
    with open(piece_model, "rb") as file:
        model_b = context.broadcast(file.read())
    named = docs.select(docs[id_column].alias("_id"), docs["text"].cast("string").alias("_text"))
    kind = named.schema["_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevelSide(model_a.value), PieceSide(model_b.value))
        numbers = pa.list_(pa.int64())
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for span in bounded(sizes, TOGETHER):
                ids, texts = (batch.column(c).slice(span.start, len(span)) for c in (0, 1))
                rows, (total, counts) = aligner.texts(texts.to_pylist())
                ids = pa.concat_arrays([ids, pa.nulls(1, ids.type)])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        *[pa.array([*columns[i], None], pa.int64()) for i in range(4)],
                        pa.array([*columns[4], None], pa.string()),
                        pa.array([*columns[5], total], numbers),
                        pa.array([*columns[6], counts], numbers),
                    ],
                    ["_id", "_n_a", "_n_b", "_n_groups", "_n_links", "_groups", "_pairs", "_times"],
                )

    schema = (
        f"_id {kind}, _n_a bigint, _n_b bigint, _n_groups bigint, _n_links bigint, _groups string, "
        "_pairs array<bigint>, _times array<bigint>"
    )
    return named.mapInArrow(make, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """``_pair``, ``_count`` over the corpus, and ``_best``: whether no A id meets its B id more often."""
    each = made.where("_n_a is null").select(F.explode(F.arrays_zip("_pairs", "_times")).alias("_z"))
    counts = stored(
        each.select(F.col("_z._pairs").alias("_pair"), F.col("_z._times").alias("_n"))
        .groupBy("_pair")
        .agg(F.sum("_n").alias("_count")),
        "pair-counts",
    ).withColumn("_b", F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("_b").agg(F.max("_count").alias("_most"))
    return stored(counts.join(most, "_b").select("_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best")), "pairs")


def align(docs: DataFrame, byte_model: str, piece_model: str, id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    made = aligned_rows(docs, id_column, byte_model, piece_model)
    made = stored(made.withColumn("_row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = pair_counts(made)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    rows = made.where("_n_a is not null")
    each = rows.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_z"))
    weighed = (
        each.select("_row", F.col("_z._pairs").alias("_pair"), F.col("_z._times").alias("_n"))
        .join(counts, "_pair")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("_best"), F.col("_n")).otherwise(0)).alias("_n_best"),
            F.sum(F.col("_n") * F.col("_count")).alias("_count_sum"),
        )
    )
    figures = rows.select("_row", "_id", "_n_a", "_n_b", "_n_groups", "_n_links", "_groups")
    return figures.join(weighed, "_row", "left").select(
        F.col("_id").alias(id_column),
        F.col("_n_a").alias("n_a"),
        F.col("_n_b").alias("n_b"),
        F.col("_n_groups").alias("n_groups"),
        F.col("_n_links").alias("n_links"),
        F.coalesce("_n_best", F.lit(0)).alias("n_best"),
        F.coalesce("_count_sum", F.lit(0)).alias("count_sum"),
        F.col("_groups").alias("groups_sha256"),
    )
