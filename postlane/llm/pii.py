"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns come first and their spans always stay. The field then reads the *zones* of a
text, the stretches of neighbouring chunks that hold a digit or an at sign, cuts them into
tokens (letters, digits, white space, single signs) and scores whole candidate segments:
their shape, digit count, checksum, number groups and what stands before and after. Dynamic
programming over segments of at most ``MAX_TOKENS`` tokens chooses boundaries and types of a
zone together; its work is linear in the zone. Spans that overlap none of the patterns' are
added.

The field is fitted on the driver by gradient ascent of its conditional likelihood, on the
zones of a bounded, hash-chosen sample of documents (``SAMPLE_DOCS`` documents, the first
``SAMPLE_CHARS`` code points of each, ``SAMPLE_ZONES`` zones). Labels are the patterns'
spans; from telephone numbers variants without country code are derived, which no pattern
finds. The weights, a bounded dictionary, are broadcast. Every whole text is then searched;
texts without a digit or at sign never leave the JVM, as neither patterns nor zones can
find anything in them.

Defined results: a null or empty text has no spans; with nothing to learn from, only the
patterns' spans are found; of segmentations with equal scores the one with the shorter last
segment and the earlier kind wins; repeated rows get equal results. Input columns named like
the added ones are replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import hash52, others

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = "outside"

# The patterns that spans must match.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = range(13, 20)
PHONE_DIGITS = range(9, 16)

CHUNK = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
MAX_TOKENS = 16
MIN_DIGITS = 4

# Bounds of the fitting sample, and the fit's steps.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 4000
SAMPLE_ZONES = 500
ZONES_PER_SHAPE = 12
EPOCHS = 8
RATE = 0.3

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each character read once: a local part always ends at an at sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def find_ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four groups of a dotted run, from its left."""
    for run in DOTTED.finditer(text):
        groups = run[0].split(".")
        at = run.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, e, "email") for s, e in find_emails(text)]
    out += [(s, e, "ip") for s, e in find_ips(text)]
    for m in CARD.finditer(text):
        if len(m[0]) >= CARD_DIGITS.start:
            digits = digits_of(m[0])
            if len(digits) in CARD_DIGITS and passes_luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if len(digits_of(m[0])) in PHONE_DIGITS]
    return out


def zones_of(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of every stretch of chunks with a digit or at sign, one space apart."""
    start = end = -1
    for chunk in CHUNK.finditer(text):
        if not TRIGGER.search(chunk[0]):
            continue
        if start >= 0 and chunk.start() - end == 1:
            end = chunk.end()
            continue
        if start >= 0:
            yield start, text[start:end]
        start, end = chunk.span()
    if start >= 0:
        yield start, text[start:end]


def kind_of_token(token: str | None) -> str:
    if token is None:
        return "edge"
    c = token[0]
    return "digits" if "0" <= c <= "9" else "letters" if c.isalpha() else "space" if c.isspace() else c


def shape_of(text: str) -> str:
    """Runs of letters as a, of digits as 9, of white space as one space."""
    text = re.sub(r"[^\W\d_]+", "a", text)
    return re.sub(r"\s+", " ", re.sub(r"[0-9]+", "9", text))


class Zone:
    """Tokens of a zone and its candidate segments with their features."""

    def __init__(self, text: str) -> None:
        self.tokens = TOKEN.findall(text)
        self.starts = [0]
        for token in self.tokens:
            self.starts.append(self.starts[-1] + len(token))
        self.kinds = [kind_of_token(t) for t in self.tokens]

    def outside(self, i: int) -> list[str]:
        size = len(self.tokens[i])
        return [f"token={self.kinds[i]}", f"size={min(size, 8)}", f"both={self.kinds[i]}{min(size, 20)}"]

    def segments_ending(self, end: int) -> Iterator[tuple[int, list[str], list[str]]]:
        """Start, possible kinds and features of the candidate segments up to ``end``."""
        kinds = self.kinds
        if kinds[end - 1] not in ("digits", "letters"):
            return
        after = kinds[end] if end < len(kinds) else "edge"
        digits, at_sign = 0, False
        for start in range(end - 1, max(end - MAX_TOKENS, 0) - 1, -1):
            kind = kinds[start]
            if kind == "digits":
                digits += len(self.tokens[start])
            at_sign |= kind == "@"
            if kind in ("space", ")", ".", "-"):
                continue
            if not at_sign and digits < MIN_DIGITS:
                continue
            text = "".join(self.tokens[start:end])
            checked = digits in CARD_DIGITS and passes_luhn(digits_of(text))
            shape = shape_of(text)
            groups = shape.count("9")
            four = groups == 4 and "a" not in shape and all(len(g) <= 3 for g in re.findall("[0-9]+", text))
            possible = (at_sign, four, checked, digits in PHONE_DIGITS)
            allowed = [k for k, yes in zip(KINDS, possible) if yes]
            if not allowed:
                continue
            before = kinds[start - 1] if start else "edge"
            yield start, allowed, [
                f"shape={shape}",
                f"letters={'a' in shape}",
                f"at={shape.count('@')}",
                f"digits={min(digits, 20)}",
                f"checksum={checked}",
                f"groups={groups}",
                f"octets={all(len(g) <= 3 and int(g) <= 255 for g in re.findall('[0-9]+', text))}",
                f"before={before}",
                f"after={after}",
            ]


Weights = dict[tuple[str, str], float]


def segment_scores(zone: Zone, weights: Weights) -> list[list[tuple[int, str, float, list[str]]]]:
    """For every end, its candidates as (start, label, score, features)."""
    get = weights.get
    out: list[list[tuple[int, str, float, list[str]]]] = [[]]
    for end in range(1, len(zone.tokens) + 1):
        features = zone.outside(end - 1)
        here = [(end - 1, OUTSIDE, sum(get((OUTSIDE, f), 0.0) for f in features), features)]
        for start, allowed, features in zone.segments_ending(end):
            for kind in allowed:
                here.append((start, kind, sum(get((kind, f), 0.0) for f in features), features))
        out.append(here)
    return out


def best_segments(zone: Zone, weights: Weights) -> list[Span]:
    """Personal data of the best segmentation, by dynamic programming over segments."""
    best, back = [0.0], [(0, OUTSIDE)]
    for here in segment_scores(zone, weights)[1:]:
        score, start, label = max(
            ((best[s] + value, s, label) for s, label, value, _ in here), key=lambda x: (x[0], x[1], -len(x[2]))
        )
        best.append(score)
        back.append((start, label))
    spans, at = [], len(zone.tokens)
    while at:
        start, label = back[at]
        if label != OUTSIDE:
            spans.append((zone.starts[start], zone.starts[at], label))
        at = start
    return spans[::-1]


def gradient(zone: Zone, gold: list[Span], weights: Weights) -> dict[tuple[str, str], float]:
    """Observed minus expected features of one zone: forward and backward over segments."""
    scored = segment_scores(zone, weights)
    n = len(zone.tokens)
    ahead = [0.0] + [-math.inf] * n
    for end in range(1, n + 1):
        ahead[end] = float(np.logaddexp.reduce([ahead[s] + v for s, _, v, _ in scored[end]]))
    behind = [-math.inf] * n + [0.0]
    for end in range(n, 0, -1):
        for s, _, v, _ in scored[end]:
            behind[s] = float(np.logaddexp(behind[s], behind[end] + v))
    true = {(s, e): kind for s, e, kind in gold}
    covered = {i for s, e, _ in gold for i in range(n) if s <= zone.starts[i] < e}
    change: dict[tuple[str, str], float] = {}
    for end in range(1, n + 1):
        for s, label, v, features in scored[end]:
            expected = math.exp(min(ahead[s] + v + behind[end] - ahead[n], 0.0))
            if label == OUTSIDE:
                observed = float(s not in covered)
            else:
                observed = float(true.get((zone.starts[s], zone.starts[end])) == label)
            if abs(observed - expected) > 1e-4:
                for f in features:
                    change[label, f] = change.get((label, f), 0.0) + observed - expected
    return change


def labelled_zones(texts: list[str]) -> list[tuple[Zone, list[Span]]]:
    """Training zones with the patterns' spans as labels, and derived variants."""
    out: list[tuple[Zone, list[Span]]] = []
    shapes: dict[str, int] = {}

    def add(zone_text: str, spans: list[Span]) -> None:
        zone = Zone(zone_text)
        shape = shape_of(zone_text)
        borders = set(zone.starts)
        usable = all(s in borders and e in borders and zone.starts.index(e) - zone.starts.index(s) <= MAX_TOKENS for s, e, _ in spans)
        if usable and shapes.get(shape, 0) < ZONES_PER_SHAPE and len(out) < SAMPLE_ZONES and len(zone.tokens) <= 60:
            shapes[shape] = shapes.get(shape, 0) + 1
            out.append((zone, spans))

    for text in texts:
        for _, zone_text in zones_of(text):
            spans = sorted(base_spans(zone_text))
            if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
                continue
            add(zone_text, spans)
            for start, end, kind in spans:
                local = re.fullmatch(r"\+[0-9]{1,3}[ .-]?(.*)", zone_text[start:end])
                if kind == "phone" and len(spans) == 1 and local and len(digits_of(local[1])) >= 9:
                    for variant in (local[1], re.sub(r"[()]", "", local[1]).replace(" ", "-")):
                        add(zone_text[:start] + variant + zone_text[end:], [(start, start + len(variant), "phone")])
    return out


def fit(docs: DataFrame, id_column: str = "doc_id") -> Weights:
    """Weights of the field from a bounded sample of documents with ``text``."""
    candidates = docs.where(F.col("text").rlike("[0-9@]")).withColumn("_order", hash52(9, id_column))
    # Hashes alone decide first, so that tasks send no texts but those of the sample.
    last = candidates.select("_order").orderBy("_order").limit(SAMPLE_DOCS).agg(F.max("_order")).first()[0]
    chosen = candidates.where(F.col("_order") <= (-1 if last is None else last))
    rows = (
        chosen.select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "_order")
        .orderBy("_order", "text")
        .limit(SAMPLE_DOCS)
        .collect()
    )
    zones = labelled_zones([r["text"] for r in rows])
    weights: Weights = {}
    squares: dict[tuple[str, str], float] = {}
    for _ in range(EPOCHS if any(gold for _, gold in zones) else 0):
        for zone, gold in zones:
            for key, step in gradient(zone, gold, weights).items():
                squares[key] = squares.get(key, 1e-6) + step * step
                weights[key] = weights.get(key, 0.0) + RATE * step / math.sqrt(squares[key])
    return weights


def all_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these together with what the field adds."""
    base = base_spans(text)
    if not weights:
        return base, base
    taken = sorted(base)
    added = []
    for at, zone_text in zones_of(text):
        for start, end, kind in best_segments(Zone(zone_text), weights):
            if not any(s < at + end and at + start < e for s, e, _ in near(taken, at, at + len(zone_text))):
                added.append((at + start, at + end, kind))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda x: (order[x[2]], x[0], x[1]))


def near(spans: list[Span], low: int, high: int) -> list[Span]:
    """Those of the spans, sorted by start, that may overlap a zone; base spans of different
    kinds may overlap each other, so a few earlier ones are looked at too."""
    from bisect import bisect_left

    first = bisect_left(spans, (low, -1, ""))
    while first and spans[first - 1][1] > low:
        first -= 1
    return spans[first : bisect_left(spans, (high, -1, ""))]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def figures(text: str, weights: Weights) -> tuple:
    base, everything = all_spans(text, weights)
    counts = [sum(k == kind for *_, k in base) for kind in KINDS]
    return (*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(everything))


def find_personal_data(docs: DataFrame, weights: Weights) -> DataFrame:
    """Adds the counts of the patterns' spans, their digest, and all spans as text."""
    counts = [f"n_{kind}" for kind in KINDS]
    names = [*counts, "base_sha256", "spans"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nothing = figures("", {})
        for texts in batches:
            yield pd.DataFrame([figures(t, shared.value) if t else nothing for t in texts], columns=names)

    own = others(docs, *names)
    worth = F.when(docs["text"].rlike("[0-9@]"), docs["text"])
    return docs.select(*own, found(worth).alias("__found")).select(
        *own, *[F.col(f"__found.{c}").alias(c) for c in names]
    )
