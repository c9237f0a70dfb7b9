import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import repeats

LENGTH, ANCHOR = 24, 8


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a : a + length] for _, b in texts for a in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats(prose):
    r = random.Random(5)
    shared = prose(99, 12)
    rows = [(i, prose(i, 30)) for i in range(40)]
    rows += [(100 + i, prose(200 + i, 6) + " " + shared + " " + prose(300 + i, 6)) for i in range(30)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    for i in range(20):
        text = rows[i][1]
        at = r.randint(0, len(text) - 1)
        rows.append((300 + i, text[:at] + "#" + text[at + 1 :]))
    rows += [(400, None), (401, ""), (402, "é" * 40), (403, "a" * 300), (404, "ab" * 50), (None, shared), (405, rows[3][1]), (405, rows[3][1]), (406, "x" * 23), (407, "x" * 23)]
    return rows


@pytest.mark.parametrize("group", [1000, 3])
def test_against_all_windows(docs, prose, group):
    rows = rows_with_repeats(prose)
    found = repeats.without_repeats(docs(rows), LENGTH, ANCHOR, group)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, LENGTH)


def test_empty_table(docs):
    assert repeats.without_repeats(docs([])).collect() == []


def test_boundaries_are_common_prefixes():
    r = random.Random(1)
    for length in (1, 3, 8):
        text = np.array([r.randint(1, 2) for _ in range(200)] + [0])
        t = repeats.Transform(text, length)
        full = [text[i:].tolist() for i in t.order]
        want = [i == 0 or full[i][:length] != full[i - 1][:length] or 0 in full[i][:length] or 0 in full[i - 1][:length] for i in range(len(full))]
        got = t.boundaries(length).tolist()
        inside = [i for i in range(1, len(full)) if len(full[i]) > length and len(full[i - 1]) > length]
        assert [got[i] for i in inside] == [want[i] for i in inside]
        assert all(got[i] or not (full[i][:length] != full[i - 1][:length] and i in inside) for i in range(len(full)))


def test_long_text_in_pieces():
    data = np.frombuffer(random.Random(3).randbytes(1000) * 20_000, np.uint8)[: (1 << 24) + 5000]
    row, key, own, first, count, lead = repeats.stretches(data, np.array([0, len(data)]), 400, 128)
    assert int(count.sum()) == len(data) - 399 and (np.diff(first) > 0).all()
