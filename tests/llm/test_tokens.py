import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickerloom.llm import packing, records
from tickerloom.llm.shared import new_path
from tickerloom.llm.tokens import END_ID, Encoder, vocabulary

TEXTS = [
    "", "a", " a", "a ", "a  b", "x\ny z.", "x\n\ny", "it's we'll. 'S don't", "é x", "<|endoftext|> a<|endoftext|>b", "a., b.. c,", "K. K, Kk.", "日本語 テスト 한국",
    "1.5 2, x2, é, É.", "It’s a “test”.", "tab\tand\rreturn", "no break", "\x1cx", "ﬁn. ǅ, ß.", "word " * 50, "A\nB c\nd.", "Ünï cödé Wörds, ÀÉ.",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name, prose, monkeypatch):
    own = Encoder(vocabulary(name))
    texts = TEXTS + [prose(i, 50) + "." for i in range(30)] + [prose(i, 9).upper() for i in range(5)]
    want = [[*ids, END_ID] for ids in own.whole(texts)]
    for limit in (10**6, 40, 2):  # the memory is emptied in between, results stay
        monkeypatch.setattr("tickerloom.llm.tokens.REMEMBERED", limit)
        ids, lengths = own.encode(texts)
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), [0], [9]).tolist() == [0xE3069283]
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    starts, lengths = [0, 10, 100, 700, 0, 5], [64, 65, 2900, 1, 0, 63]
    assert records.crc32c(data, starts, lengths).tolist() == [slow_crc(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


def rows_for_tokens(prose):
    return [(5, prose(1, 40)), (3, None), (-2, ""), (9, prose(2, 2000)), (4, "a  b"), (4, "a  b"), (None, "x"), *((20 + i, prose(i, 30)) for i in range(40))]


def test_records_round_trip(spark, docs, prose):
    rows, own = rows_for_tokens(prose), Encoder(vocabulary("word_bpe_49k.json"))
    folder = new_path(spark, "test-records")
    manifest = records.write_records(docs(rows), folder)
    got = records.read_records(manifest).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t in ordered:
        ids = [*own.whole([t or ""])[0], END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    path = next(m.path for m in manifest.collect() if m.n_records > 2)
    plain = [(r, d, i.tolist()) for r, d, i in records.read_file(path)]
    order = np.random.default_rng(1).permutation(len(plain))
    assert [(r, d, i.tolist()) for r, d, i in records.read_file(path, order)] == [plain[k] for k in order]
    file = path.removeprefix("file://") + ".records"
    body = bytearray(open(file, "rb").read())
    assert struct.unpack_from("<Q", body)[0] + 16 <= len(body)
    body[20] ^= 1
    open(file, "wb").write(body)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_file(path))


def test_records_of_nothing(docs):
    assert records.token_records(docs([])).collect() == []


def test_places_fill_windows_evenly():
    r = random.Random(4)
    for trial in range(200):
        totals = [r.randint(0, 300) for _ in range(r.randint(1, 6))]
        weights = totals if trial % 2 else [r.randint(0, 5) for _ in totals]
        size, seen = r.choice([1, 7, 16, 64]), {}
        plan = packing.phases(totals, weights)
        for j, total in enumerate(totals):
            first = 0
            while first < total:
                n, got = r.randint(1, total - first), 0
                for window, place, a, k in packing.places(plan, j, first, n, size):
                    assert a == first + got and k > 0
                    seen.update({(window, place + i): j for i in range(k)})
                    got += k
                assert got == n
                first += n
        assert sorted(seen) == [(x // size, x % size) for x in range(sum(totals))]


def test_windows_keep_the_mixture(docs, prose):
    rows = [(i, prose(i, 200)) for i in range(60)]
    for weights in (None, {"s0": 0.5, "s1": 0.25, "s2": 0.25}):
        pieces = packing.pack(docs(rows), size=256, weights=weights).collect()
        n = sum(p.length for p in pieces)
        by = defaultdict(lambda: defaultdict(int))
        for p in pieces:
            by[p.sequence_id][p.doc_id % 3] += p.length
        for w in range(4):
            shares = [0.5, 0.25, 0.25] if weights else [sum(p.length for p in pieces if p.doc_id % 3 == s) / n for s in range(3)]
            assert all(abs(by[w][s] - 256 * shares[s]) <= 3 for s in range(3))


def test_pieces_of_all_documents(docs, prose):
    rows, own = rows_for_tokens(prose), Encoder(vocabulary("byte_bpe_50k.json"))
    pieces = packing.pack(docs(rows), size=128).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*own.whole([t or ""])[0], END_ID])
    windows, found = defaultdict(list), defaultdict(int)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        ids = want[p.doc_id][0]
        assert p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        found[p.doc_id] += p.length
    assert found == {i: sum(map(len, w)) for i, w in want.items()}
    total, last = sum(found.values()), max(windows)
    for w, parts in windows.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == (128 if w < last else total - 128 * last)
    assert {p.pad for p in pieces if p.sequence_id < last} <= {0}
    assert packing.padding(64, 128) == 0 and packing.padding(65, 128) == 63
    assert packing.pack(docs([])).collect() == []
