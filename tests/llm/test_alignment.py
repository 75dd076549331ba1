import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postlane.llm import alignment

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(libraries, text):
    """(id, bytes) of both sides over the whole text, or none."""
    a, b = libraries
    letters = alignment.byte_letters()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    ours = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    theirs = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    same = all(b"".join(t for _, t in side) == (" " + text).encode() for side in (ours, theirs))
    return (ours, theirs) if same else ([], [])


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, texts):
    rows, counts = [], collections.Counter()
    for text in texts:
        a, b = map(spans, tokens(libraries, text)) if text else ([], [])
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for cut in cuts:
            own = [",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)]
            groups.append("|".join(own))
            start = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (
            n_a,
            n_b,
            n_groups,
            len(links),
            sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(shown.encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, n_groups, links, shown in rows
    ]


def random_text(rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return "".join(rnd.choice("abcdeé thein  \n\t.,ßñ漢字😀\x00　 \x1cﬁ'sA0129") for _ in range(rnd.randrange(60)))
    if kind == 1:
        return " ".join(rnd.choice(["the", "Wörter", "unbelievable", "don't", "1234567", "<s>", "<|endoftext|>"]) for _ in range(30))
    if kind == 2:
        return "  ".join("".join(rnd.choice("etaoinß") for _ in range(rnd.randrange(12))) for _ in range(20))
    return rnd.choice(["", " ", "\n", "a▁b", "▁", " x", "x ", "<unk>", "</s>", "漢字 かな"])


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def figures(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("together, broadcast", [(1 << 22, 1_000_000), (50, 0)])
def test_equals_brute_force(documents, libraries, monkeypatch, together, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    rnd = random.Random(3)
    texts = [random_text(rnd) for _ in range(300)]
    monkeypatch.setattr(alignment, "TOGETHER", together)
    got = figures(alignment.align(documents(*enumerate(texts)), BYTES, PIECES))
    assert got == dict(enumerate(brute(libraries, texts)))


def test_chunks_are_encoded_as_whole_texts(libraries):
    rnd = random.Random(4)
    a, b = alignment.ByteLevelSide(open(BYTES, encoding="utf-8").read()), alignment.PieceSide(open(PIECES, "rb").read())
    for _ in range(3000):
        text = random_text(rnd)
        if not text:
            continue
        chunks = alignment.CUT.split(text)
        assert sum(a.encode(chunks), []) == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert sum(b.encode(chunks), []) == libraries[1].encode(text)


def test_pointer_jumping_labels_long_components():
    import numpy as np

    # Tokens of two bytes, shifted by one: one component however long.
    many = 1000
    ends_a = np.append(np.arange(2, 2 * many, 2), 2 * many)
    ends_b = np.append(np.arange(1, 2 * many, 2), 2 * many)
    assert set(alignment.terminals(ends_a, ends_b)) == {len(ends_a) + len(ends_b) - 1}
    a, b = alignment.linked(ends_a, ends_b)
    starts_a, starts_b = (np.append(0, e[:-1]) for e in (ends_a, ends_b))
    assert len(a) == 2 * many and (starts_a[a] < ends_b[b]).all() and (starts_b[b] < ends_a[a]).all()


def test_odd_rows(documents, odd_rows, libraries):
    out = alignment.align(documents(*odd_rows, clashing=True), BYTES, PIECES)
    assert out.columns == ["doc_id", *COLUMNS]
    rows = collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out.collect())
    short = [r for r in odd_rows if r[0] != 6]
    # The long text's links count too, so sums are compared without it.
    without = alignment.align(documents(*short), BYTES, PIECES)
    expected = collections.Counter((r[0], *f) for r, f in zip(short, brute(libraries, [r[1] for r in short])))
    assert collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in without.collect()) == expected
    assert sum(rows.values()) == len(odd_rows)
    assert rows[(None, 0, 0, 0, 0, 0, 0, "")] == rows[(1, 0, 0, 0, 0, 0, 0, "")] == rows[(2, 0, 0, 0, 0, 0, 0, "")] == 1
    assert rows[(7, 0, 0, 0, 0, 0, 0, "")] == 1  # has the piece model's own space sign
    long = next(r for r in rows if r[0] == 6)
    text = next(r[1] for r in odd_rows if r[0] == 6)
    assert long[1] == len(libraries[0].encode(" " + text, add_special_tokens=False).ids)
    assert alignment.align(documents(), BYTES, PIECES).count() == 0
