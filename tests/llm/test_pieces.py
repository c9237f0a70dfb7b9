"""Ids and texts of the SentencePiece vocabulary against the library itself."""

import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from tickerloom.llm import pieces
from tickerloom.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=vocabulary(pieces.VOCABULARY))


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(vocabulary(pieces.VOCABULARY))


def mixed_texts(n, seed=1):
    r = random.Random(seed)
    signs = ["the ing over er on re  ", "aaab", "éàß日本梦ゼ\U0001F600", "\n\r\t\x00▁<s></s><0x0A>", "0123456789,.;:!?()[]{}"]
    signs.append("".join(signs))
    runs = ["the", "  ", "\n", "    ", "tion", "aaaa", "▁▁", " "]
    out = []
    for _ in range(n):
        alphabet = r.choice(signs)
        out.append("".join(r.choice(alphabet) if r.random() < 0.8 else r.choice(runs) for _ in range(r.randint(0, 60))))
    return out


def split(ids, lengths):
    ends = np.cumsum(lengths)
    return [ids[a:b].tolist() for a, b in zip(ends - lengths, ends)]


def test_ids_are_the_librarys(ours, library):
    texts = mixed_texts(6000) + ["a" * 3000, "ab" * 2000, " " * 2000, "the" * 2000, "".join(random.Random(2).choices("etaoinshr", k=8000))]
    got = split(*ours.encode(texts))
    assert got == [library.encode(t) for t in texts]
    assert ours.decode(*ours.encode(texts)) == [library.decode(i) for i in got]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "AT_ONCE", 7)
    small = pieces.Pieces(vocabulary(pieces.VOCABULARY))
    for k in range(20):
        texts = mixed_texts(30, seed=k)
        assert split(*small.encode(texts)) == [library.encode(t) for t in texts]
    assert len(small.known) < 2000


def test_any_ids_decode_as_in_the_library(ours, library):
    r = random.Random(3)
    rows = [[r.choice([r.randrange(32000), r.randrange(400), r.randrange(300)]) for _ in range(r.randint(0, 8))] for _ in range(5000)]
    got = ours.decode(np.array([i for row in rows for i in row]), np.array([len(row) for row in rows]))
    assert got == [library.decode(row) for row in rows]
    with pytest.raises(ValueError):
        ours.decode(np.array([32000]), np.array([1]))


def test_words_are_cut_only_where_no_piece_crosses(library):
    whole = pieces.Pieces(vocabulary(pieces.VOCABULARY))
    whole.cuts = False
    texts = mixed_texts(300, seed=9)
    assert split(*whole.encode(texts)) == [library.encode(t) for t in texts]


def test_query_rows(spark, docs, library):
    rows = [(1, "Plain text, here."), (2, ""), (3, None), (3, None), (None, "x\ny"), (5, "long " * 40_000), (6, "q" * 5000), (7, "  two  spaces "), (7, "twice"), (7, "twice")]
    table = docs(rows).withColumnRenamed("row", "ids").withColumnRenamed("digest", "decoded")
    got = pieces.digests(pieces.decode(pieces.encode(table))).collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = [(d, library.encode(t or "")) for d, t in rows]
    want = [(d, len(i), digest(",".join(map(str, i))), digest(library.decode(i))) for d, i in want]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_round_trip_and_empty_table(spark, docs):
    texts = ["Un mot et l'autre.\nPuis la fin", "tab\tand 日本 \U0001F600"]
    out = pieces.decode(pieces.encode(docs([(i, t) for i, t in enumerate(texts)]))).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == texts
    assert pieces.digests(pieces.decode(pieces.encode(docs([])))).count() == 0
