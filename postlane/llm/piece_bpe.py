"""Encoding and decoding with a merge-based piece model, by a table of last tokens.

The encoding of every prefix of a text ends in one token that no other encoding rule
could give. The table of these last tokens is filled from left to right: an automaton
over all pieces finds the tokens that end at a position, and the one that belongs there
is the one whose predecessor, the last token of the prefix before it, would stay separate
from it. Whether two tokens stay separate depends on these two only and is remembered.
Following the table from the end gives the ids backwards.

A text is cut where no piece reaches across, so encodings of its parts are independent.
Ids of repeated parts are remembered, in two generations: a full one becomes the old one,
from which parts that come again are taken over, so that frequent parts are never lost. Both
are bounded in bytes, as is the memory of pairs. A worker process builds its table once. The
model file is read on the driver and broadcast (its size is fixed); texts never leave their
partition, and results leave it in batches of bounded size.

Defined results: a null text counts as empty; an empty text has the end id only; characters
outside the model become their bytes; decoding shows each byte that is not UTF-8 as a
replacement character; repeated rows get equal results; a null id or other column is kept; an
empty table gives an empty result. Very long texts are split in windows of 64 K characters;
only their ids are held as a whole. Input columns with the names of added ones are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlane.llm.common import bounded, others

SPACE = "▁"
# What decoding shows for the unknown id.
UNKNOWN = " \u2047 ".encode()
# Name of the error handler that shows every byte outside UTF-8 as a replacement character.
ONE_EACH = "one replacement per byte"
# Stands between texts (Unicode reserves it as no character), and for the place where one begins.
MARK, FIRST = "\uffff", -2
# Bytes of one generation of remembered parts, and what a remembered part takes besides its own.
REMEMBERED, ENTRY = 32 << 20, 200
# Pairs of tokens that are remembered.
PAIRS = 200_000
# Characters of a text that are split at a time, and of texts whose results leave together.
WINDOW, TOGETHER = 1 << 16, 1 << 22


class PieceTable:
    """Encoder and decoder of one piece model."""

    def __init__(self, model: bytes) -> None:
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(source.vocab_size())
        if any(source.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        codecs.register_error(ONE_EACH, lambda e: ("\ufffd" * (e.end - e.start), e.end))
        self.end_id = source.eos_id()
        self.unknown_id = source.unk_id()
        self.bytes_from = source.piece_to_id("<0x00>")
        special = lambda i: source.is_control(i) or source.is_unknown(i) or source.is_byte(i)
        self.piece = [None if special(i) else source.id_to_piece(i) for i in ids]
        self.is_byte = [source.is_byte(i) for i in ids]
        self.score = {p: source.get_score(i) for i, p in enumerate(self.piece) if p is not None}
        # Characters that stand in pieces only are tokens as well; they end up as bytes.
        letters = sorted({c for p in self.score for c in p} - set(self.score))
        self.token = [*self.piece, *letters]
        self.number = {p: i for i, p in enumerate(self.token) if p is not None}
        if any(SPACE in p.lstrip(SPACE) or MARK in p for p in self.score):
            raise ValueError("pieces with inner spaces or the mark are not supported")
        known = "".join(re.escape(c) for c in sorted({c for p in self.number for c in p} - {SPACE}))
        self.parts = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]+")
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        # Per token, those that stay separate before it or not, and how many are known in all.
        self.separate: list[dict[int, bool]] = [{} for _ in self.token]
        self.pairs = 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.length = [len(t or "") for t in self.token]
        # Bytes that tokens without an id become, last one first.
        self.becomes = {
            i: [self.bytes_from + b for b in reversed(self.token[i].encode())] for i in range(len(self.piece), len(self.token))
        }
        # Per id its decimal digits and what it stands for; control ids stand for nothing.
        self.digits = [str(i) for i in ids]
        self.stands_for = [
            bytes([i - self.bytes_from]) if self.is_byte[i] else UNKNOWN if i == self.unknown_id else (self.piece[i] or "").encode()
            for i in ids
        ]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            if self.steps(i)[-1][1] == p:  # a piece that no merges lead to never occurs
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def steps(self, token: int) -> list[tuple[float, str, str]]:
        """Scores of a token's own merges, each with the first and last symbol after it."""
        symbols = list(self.token[token])
        steps = [(float("inf"), symbols[0], symbols[-1])]
        while len(symbols) > 1:
            scores = [self.score.get(a + b, float("-inf")) for a, b in zip(symbols, symbols[1:])]
            best = max(scores)
            if best == float("-inf"):
                break
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return steps

    def history(self, token: int) -> list[tuple[float, str, str]]:
        """The steps of a token that a text has, which are kept."""
        if token not in self.merges:
            self.merges[token] = self.steps(token)
        return self.merges[token]

    def stay_separate(self, a: int, b: int) -> bool:
        """Whether ``a`` before ``b`` are never merged across their border.

        Both run through their own merges, best score first. A merge across happens if the
        symbols that meet at the border form a piece that is better than both next merges;
        among equals the left one goes first.
        """
        left, right = self.history(a), self.history(b)
        i = j = 0
        none = float("-inf")
        while True:
            across = self.score.get(left[i][2] + right[j][1], none)
            next_left = left[i + 1][0] if i + 1 < len(left) else none
            next_right = right[j + 1][0] if j + 1 < len(right) else none
            if across != none and across > next_left and across >= next_right:
                return False
            if next_left == none and next_right == none:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def encode_parts(self, parts: list[str]) -> Iterator[list[int]]:
        """Ids of texts without cuts, from one table of last tokens over all of them.

        The texts stand in a row with a mark between them that no piece holds.
        """
        row = MARK.join(parts)
        last = [-1] * (len(row) + 1)
        starts, at = [], 0
        for part in parts:
            last[at] = FIRST
            starts.append(at)
            at += len(part) + 1
        separate, length = self.separate, self.length
        for end, token in self.automaton.iter(row):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length[token]]
            if before != FIRST:
                known = separate[token]
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.stay_separate(before, token)
                    self.pairs += 1
                if not fits:
                    continue
            last[end] = token
        pieces = len(self.piece)
        for start, part in zip(starts, parts):
            ids: list[int] = []
            at = start + len(part)
            if last[at] < 0:  # characters outside the model
                yield [self.bytes_from + b for b in part.encode()]
                continue
            while at > start:
                token = last[at]
                if token < pieces:
                    ids.append(token)
                else:
                    ids.extend(self.becomes[token])
                at -= length[token]
            ids.reverse()
            yield ids

    def split(self, text: str) -> Iterator[list[str]]:
        """Parts of a text that no piece reaches across, spaces made visible, in windows."""
        if not text:
            return
        shown = SPACE + text.replace(" ", SPACE)
        at = 0
        while at < len(shown):
            cut = self.cut.search(shown, at + WINDOW)
            end = cut.start() if cut else len(shown)
            yield self.parts.findall(shown, at, end)
            at = end

    def packed(self, text: str) -> bytes:
        """Ids of a whole text with the end id, as 32-bit numbers."""
        out = []
        for parts in self.split(text):
            if self.young_bytes >= REMEMBERED:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            if self.pairs >= PAIRS:
                self.separate, self.pairs = [{} for _ in self.token], 0
            young, old = self.young, self.old
            missing = set(parts).difference(young)
            again = missing & old.keys()
            young.update(zip(again, map(old.__getitem__, again)))
            new = list(missing - again)
            young.update(zip(new, [array("i", ids).tobytes() for ids in self.encode_parts(new)]))
            self.young_bytes += len(missing) * ENTRY + sum(map(len, missing)) * 5
            out.append(b"".join(map(young.__getitem__, parts)))
        out.append(array("i", [self.end_id]).tobytes())
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        return memoryview(self.packed(text)).cast("i").tolist()

    def surface(self, ids: list[int]) -> bytes:
        """What ids stand for, as bytes."""
        return b"".join(map(self.stands_for.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.shown(self.surface(ids))

    def shown(self, surface: bytes) -> str:
        """Text of decoded bytes: the space put before the first word goes again."""
        text = surface.decode("utf-8", ONE_EACH)
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def figures(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of the decoded text."""
        ids = self.encode(text or "")
        spelled = " ".join(map(self.digits.__getitem__, ids))
        return len(ids), sha256(spelled), sha256(self.decode(ids))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


TABLES: dict[bytes, PieceTable] = {}


def table_of(model: bytes) -> PieceTable:
    """The table of a model, built once in a worker process."""
    name = hashlib.blake2b(model).digest()
    if name not in TABLES:
        TABLES.clear()
        TABLES[name] = PieceTable(model)
    return TABLES[name]


def read_model(model_path: str) -> bytes:
    with open(model_path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """Adds ``ids``: the ids of every whole text, the end id last."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = table_of(model.value)
        for texts in batches:
            yield pd.Series([pieces.encode(t or "") for t in texts], dtype=object)

    return docs.withColumn("ids", encoded(docs[text_column]))


def decode_ids(df: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of every array of ids."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = table_of(model.value)
        for rows in batches:
            yield pd.Series([None if ids is None else pieces.decode(list(ids)) for ids in rows], dtype=object)

    return df.withColumn("decoded", decoded(df[ids_column]))


def _with_columns(
    docs: DataFrame, model_path: str, text_column: str, added: dict[str, str], make, keep_text: bool = True
) -> DataFrame:
    """Adds columns that ``make(table, texts)`` gives as Arrow arrays for a few texts at a time.

    A text goes to Python once, and comes back only if it is kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    own = others(docs, *added)
    kept = docs.select(*own)
    is_text = [f.name == text_column and f.dataType == T.StringType() for f in kept.schema.fields]
    sent = [c for c, same in zip(own, is_text) if not same]
    # By number, as names may hold dots.
    numbered = docs.select(docs[text_column].cast("string").alias("text"), *sent).toDF(
        "text", *[f"c{i}" for i in range(len(sent))]
    )
    # Places of the returned columns among those sent.
    rest = iter(range(1, len(sent) + 1))
    placed = [(0 if same else next(rest), name) for same, name in zip(is_text, kept.columns)]
    if not keep_text:
        placed = [(at, name) for at, name in placed if name != text_column]
    names = [*[name for _, name in placed], *added]
    made = ", ".join(f"m{i} {kind}" for i, kind in enumerate(added.values()))
    schema = T.StructType([*[numbered.schema.fields[at] for at, _ in placed], *T.StructType.fromDDL(made).fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table_of(model.value)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist()
            for span in bounded(sizes, TOGETHER):
                part = batch.slice(span.start, len(span))
                arrays = make(pieces, [t or "" for t in part.column(0).to_pylist()])
                own_arrays = [part.column(at) for at, _ in placed]
                yield pa.RecordBatch.from_arrays([*own_arrays, *arrays], schema.names)

    return numbered.mapInArrow(mapped, schema).toDF(*names)


def encode_and_verify(
    docs: DataFrame, model_path: str, text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded_sha256``, the digest of what the ids decode to.

    Without ``keep_text`` the text column goes.
    """

    def make(pieces: PieceTable, texts: list[str]) -> list[pa.Array]:
        packed = [pieces.packed(t) for t in texts]
        many = [len(p) // 4 for p in packed]
        ends = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
        digests = [sha256(pieces.decode(memoryview(p).cast("i").tolist())) for p in packed]
        ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), dtype=np.int32))
        return [ids, pa.array(many, pa.int64()), pa.array(digests, pa.string())]

    added = {"ids": "array<int>", "n_tokens": "bigint", "decoded_sha256": "string"}
    return _with_columns(docs, model_path, text_column, added, make, keep_text)


def digest_texts(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without keeping the ids."""

    def make(pieces: PieceTable, texts: list[str]) -> list[pa.Array]:
        many, ids, decoded = zip(*map(pieces.figures, texts))
        return [pa.array(many, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return _with_columns(docs, model_path, text_column, added, make)
